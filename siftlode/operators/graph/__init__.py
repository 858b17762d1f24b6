"""Operators on code graphs: tables of nodes and edges.

nodes(id, project, label, name, qualified_name, file_path, start_line, end_line, properties)
edges(project, source_id, target_id, type, properties)
"""
