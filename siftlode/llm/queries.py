"""The queries of this subpackage's operators over the test tables, and SQL where a result can be stated in it."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlode.llm import credentials, knn, leakage, neardup, parsing, provenance, splitting, stuffing, tokens
from siftlode.runtime import table


def p2_found(spark, sf_dir):
    """Pairs of stored chunks whose runs of 3 words overlap by 0.6 or more."""
    return neardup.near_pairs(table(spark, sf_dir, "vector_documents"))


def p2_classes(spark, sf_dir):
    """The same at class level: each chunk with the class of equal texts it is in and that class's links."""
    members, links = neardup.near_classes(table(spark, sf_dir, "vector_documents"))
    ends = links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(ends, "rep", "left").select(F.col("id").alias("vec_id"), F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def p3_found(spark, sf_dir):
    """Files that are not valid in the language of their row."""
    return parsing.flag_files(table(spark, sf_dir, "files")).where("not valid").select("project", "rel_path").distinct()


def p3_rates(spark, sf_dir):
    return parsing.invalid_rates(parsing.flag_files(table(spark, sf_dir, "files")))


def p4_found(spark, sf_dir):
    """Lines of stored chunks where a credential literal begins."""
    found = credentials.find_credentials(table(spark, sf_dir, "vector_documents"))
    return found.select("vec_id", F.explode("lines").alias("line_no")).distinct()


def p4_redacted(spark, sf_dir):
    """All stored chunks, their credentials masked."""
    return credentials.redact(table(spark, sf_dir, "vector_documents")).select("vec_id", "content")


def p5_found(spark, sf_dir):
    return knn.similar_pairs(table(spark, sf_dir, "vector_documents"))


def p6_found(spark, sf_dir):
    """Files nobody in the project wrote."""
    return provenance.label_files(table(spark, sf_dir, "vector_documents")).where("label <> 'handwritten'").select("project", "relative_path")


def p6_labels(spark, sf_dir):
    return provenance.label_files(table(spark, sf_dir, "vector_documents")).select("project", "relative_path", "label")


def p7_found(spark, sf_dir):
    """The natural boundaries in the successor tables of all oversized chunks."""
    return splitting.boundary_table(table(spark, sf_dir, "code_chunks")).select("chunk_id", "line_no").distinct()


def p7_pieces(spark, sf_dir):
    """All chunks in pieces of at most 2,500 characters with an overlap of 300."""
    return splitting.split_chunks(table(spark, sf_dir, "code_chunks"))


def p7_joined(spark, sf_dir):
    """All chunks again, from the pieces without what they repeat, with their longest piece."""
    pieces = splitting.split_chunks(table(spark, sf_dir, "code_chunks"))
    own = F.expr("substring(content, own_from + 1)")
    parts = pieces.groupBy("chunk_id").agg(F.array_sort(F.collect_set(F.struct("piece", own.alias("own")))).alias("p"), F.max(F.length("content")).alias("longest"))
    return parts.select("chunk_id", F.array_join(F.transform("p", lambda x: x["own"]), "").alias("content"), (F.col("longest") <= 2500).alias("within"))


def p8_ids(spark, sf_dir):
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


def p8_text(spark, sf_dir):
    """All texts again, decoded from their ids."""
    return tokens.decode_corpus(tokens.encode_corpus(table(spark, sf_dir, "documents")))


def p9_found(spark, sf_dir):
    """Documents with a tile of at least 15 words of an item."""
    leaks = leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return leaks.where("longest >= 15").select("doc_id", "item_id").distinct()


def p9_reordered(spark, sf_dir):
    """Documents that hold half of an item or more in tiles of at least 5 words, in whatever order."""
    leaks = leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), min_match=5, min_coverage=0.5)
    return leaks.groupBy("doc_id", "item_id").agg(F.round(F.max("coverage"), 6).alias("coverage"))


def p9_items(spark, sf_dir):
    """Of each leaked item: documents that hold part of it, and the greatest share one document holds."""
    leaks = leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("coverage").alias("coverage"))


def p10_found(spark, sf_dir):
    return stuffing.stuffed_pages(table(spark, sf_dir, "documents"))


def p10_hosts(spark, sf_dir):
    """Of each host: its pages, its stuffed pages and its smoothed rate."""
    pages = stuffing.score_pages(table(spark, sf_dir, "documents"))
    return pages.groupBy("source").agg(F.count("*").alias("pages"), F.sum(F.when(F.col("score") > 0, 1).otherwise(0)).alias("stuffed"), F.round(F.max("host_rate"), 6).alias("host_rate"))


_QUERIES = (p2_found, p2_classes, p3_found, p3_rates, p4_found, p4_redacted, p5_found, p6_found, p6_labels, p7_found, p7_pieces, p7_joined, p8_ids, p8_text, p9_found, p9_items, p9_reordered, p10_found, p10_hosts)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """
with v as (select distinct vec_id, regexp_extract_all(content, '[A-Za-z0-9_]+') as w from vector_documents where content is not null),
s as (select distinct vec_id, lower(w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) as g from (select vec_id, w, unnest(range(1, len(w) - 1)) as k from v where len(w) >= 20)),
n as (select vec_id, count(*) as n from s group by 1),
p as (select a.vec_id as vec_id_a, b.vec_id as vec_id_b, count(*) as c from s a join s b on a.g = b.g and a.vec_id < b.vec_id group by 1, 2)
select vec_id_a, vec_id_b from p join n x on x.vec_id = vec_id_a join n y on y.vec_id = vec_id_b where c >= 0.6 * (x.n + y.n - c)""",
        "p2_classes": """
with v as (select distinct vec_id, regexp_extract_all(content, '[A-Za-z0-9_]+') as w from vector_documents where content is not null),
s as (select distinct vec_id, lower(w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) as g from (select vec_id, w, unnest(range(1, len(w) - 1)) as k from v where len(w) >= 20)),
k as (select vec_id, count(*) as n, md5(array_to_string(list_sort(list(g)), chr(10))) as key from s group by 1),
c as (select vec_id, n, min(vec_id) over (partition by key) as class_id from k),
t as (select s.* from s join c on c.vec_id = s.vec_id and c.vec_id = c.class_id),
p as (select a.vec_id as a, b.vec_id as b, count(*) as c from t a join t b on a.g = b.g and a.vec_id < b.vec_id group by 1, 2),
l as (select p.* from p join c x on x.vec_id = a join c y on y.vec_id = b where p.c >= 0.6 * (x.n + y.n - p.c)),
e as (select class_id, count(*) as links from (select a as class_id from l union all select b from l) group by 1)
select vec_id, class_id, coalesce(links, 0) as links from c left join e using (class_id)""",
        "p7_joined": "select distinct chunk_id, content, true as within from code_chunks where content is not null",
        "p8_text": "select distinct doc_id, coalesce(text, '') as text from documents",
        "p9_found": """
with w as (select doc_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) as w from documents where text is not null),
i as (select item_id, list_transform(regexp_extract_all(item_text, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) as w from eval_items where item_text is not null),
d as (select distinct doc_id, array_to_string(w[k:k+14], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 13)) as k from w where len(w) >= 15)),
e as (select distinct item_id, array_to_string(w[k:k+14], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 13)) as k from i where len(w) >= 15))
select distinct doc_id, item_id from d join e using (g)""",
    }
