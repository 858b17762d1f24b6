"""Resolving calls to definitions by a chain of strategies.

registry(project, seq, name, qualified_name, label); calls(project, call_id, callee, module_qn, import_keys,
import_vals). A registry is one project's: calls resolve only to definitions of their own project, and candidates are
counted there. Without a column ``project`` all rows are of one project. Each strategy is an equi-join that gives
candidates with a priority; the first strategy that gives any wins, and within it the best candidate. A name with more
than ``MAX_CANDIDATES`` definitions in a project resolves by no name-based strategy, so joins by name are against at
most that many rows a project and name. Call ids are unique over all projects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlode.functions.text import common_prefix, is_test_name, simple_name
from siftlode.runtime import cut

MAX_CANDIDATES = 256
#: The confidence of each strategy.
CONFIDENCE = {"import_map": 0.95, "import_map_suffix": 0.85, "same_module": 0.90, "qualified_suffix": 0.90, "unique_name": 0.75, "suffix_match": 0.55, "fuzzy_single": 0.40, "fuzzy_multi": 0.30}


def _reachable(imports: Column, qn: Column) -> Column:
    """Whether any import names the candidate's module or a part of it, or the other way round."""
    module = F.regexp_replace(qn, r"[.:]+[^.:]*$", "")
    return F.exists(imports, lambda v: (v != "") & (module.contains(v) | v.contains(module)))


def _score(qn: Column, module: Column) -> Column:
    return F.when(is_test_name(simple_name(qn)) | F.lower(qn).rlike(r"(^|[._/])(test|mock|stub|fake|fixture|spec)s?[._/]"), 0).otherwise(1000) + common_prefix(qn, module)


def _named(df: DataFrame) -> DataFrame:
    return df if "project" in df.columns else df.withColumn("project", F.lit(""))


def _crowds(registry: DataFrame, count: str) -> DataFrame:
    """(project, simple, qualified_name, seq, count) of the definitions whose name is not too common in their project."""
    reg = _named(registry).select("project", "seq", "qualified_name", simple_name(F.col("qualified_name")).alias("simple"))
    crowd = reg.groupBy("project", "simple").agg(F.count("*").alias(count))
    return reg.join(crowd.where(F.col(count) <= MAX_CANDIDATES), ["project", "simple"])


def resolve_calls(calls: DataFrame, registry: DataFrame) -> DataFrame:
    """(call_id, qualified_name, strategy, confidence, candidate_count); unresolved calls have an empty name and 0."""
    reg = _named(registry).select("project", "seq", "qualified_name")
    byname = _crowds(registry, "n_all")
    prefix = F.regexp_extract("callee", r"^(.*?)(?:\.|::)", 1)
    rest = F.regexp_replace("callee", r"^.*?(?:\.|::)", "")
    imports = F.map_from_arrays("import_keys", "import_vals")
    base = _named(calls).select("project", "call_id", "callee", "module_qn", "import_keys", "import_vals", simple_name(F.col("callee")).alias("simple"), prefix.alias("prefix"), F.when(prefix == "", F.lit(None)).otherwise(F.regexp_replace(rest, "::", ".")).alias("rest"))
    base = base.withColumn("whole", F.try_element_at(imports, F.col("callee"))).withColumn("via", F.try_element_at(imports, F.col("prefix")))
    any_import = F.size(F.filter("import_vals", lambda v: v != "")) > 0

    base = cut(base, "calls")  # read by every strategy

    def exact(name: Column, strategy: str, priority: int) -> Column:
        return F.struct(name.alias("qualified_name"), F.lit(strategy).alias("strategy"), F.lit(CONFIDENCE[strategy]).alias("confidence"), F.lit(1).cast("long").alias("candidate_count"), F.lit(priority).alias("priority"))

    whole_names = F.array(
        exact(F.coalesce(F.concat("via", F.lit("."), "rest"), F.concat("whole", F.lit("."), "simple")), "import_map", 1),
        exact(F.when(F.col("rest").isNull(), F.col("whole")), "import_map", 1),
        exact(F.concat("module_qn", F.lit("."), "callee"), "same_module", 3),
        exact(F.concat("module_qn", F.lit("."), "rest"), "same_module", 3),
    )
    direct = base.select("project", "call_id", F.explode(whole_names).alias("x")).select("project", "call_id", "x.*").where("qualified_name is not null")
    direct = direct.join(reg.select("project", "qualified_name"), ["project", "qualified_name"], "left_semi").select("call_id", "qualified_name", "strategy", "confidence", "candidate_count", "priority")
    named = base.join(byname, ["project", "simple"]).select("call_id", "callee", "module_qn", "import_vals", "via", "rest", any_import.alias("any_import"), "qualified_name", "seq", "n_all")
    named = cut(named.withColumn("reach", _reachable(F.col("import_vals"), F.col("qualified_name"))).withColumn("score", _score(F.col("qualified_name"), F.col("module_qn"))), "named")
    per = Window.partitionBy("call_id")
    via = named.where(F.col("via").isNotNull() & F.col("rest").isNotNull() & F.col("qualified_name").startswith(F.concat("via", F.lit("."))))
    via = via.withColumn("k", F.row_number().over(per.orderBy(F.desc("score"), "seq"))).where("k = 1").select("call_id", "qualified_name", F.lit("import_map_suffix").alias("strategy"), F.lit(CONFIDENCE["import_map_suffix"]).alias("confidence"), F.lit(1).cast("long").alias("candidate_count"), F.lit(2).alias("priority"))
    suffix = named.where(F.col("rest").isNotNull() & F.col("qualified_name").endswith(F.concat(F.lit("."), F.regexp_replace("callee", "::", "."))) & (F.col("n_all") > 1))
    suffix = suffix.withColumn("m", F.count("*").over(per)).where("m = 1").select("call_id", "qualified_name", F.lit("qualified_suffix").alias("strategy"), F.lit(CONFIDENCE["qualified_suffix"]).alias("confidence"), F.col("n_all").alias("candidate_count"), F.lit(4).alias("priority"))
    single = named.where("n_all = 1").select("call_id", "qualified_name", F.lit("unique_name").alias("strategy"), F.when(F.col("any_import") & ~F.col("reach"), CONFIDENCE["unique_name"] / 2).otherwise(CONFIDENCE["unique_name"]).alias("confidence"), F.col("n_all").alias("candidate_count"), F.lit(5).alias("priority"))
    many = named.where("n_all > 1").withColumn("n_reach", F.sum(F.when(F.col("reach"), 1).otherwise(0)).over(per)).where("n_reach = 0 or reach")
    many = many.withColumn("k", F.row_number().over(per.orderBy(F.desc("score"), "seq"))).where("k = 1")
    n = F.when(F.col("n_reach") > 1, F.col("n_reach")).otherwise(F.col("n_all"))
    conf = F.when((F.col("n_reach") == 0) & F.col("any_import"), CONFIDENCE["suffix_match"] / 2).otherwise(CONFIDENCE["suffix_match"]) * F.least(F.lit(1.0), F.lit(5.0) / n)
    many = many.select("call_id", "qualified_name", F.lit("suffix_match").alias("strategy"), conf.alias("confidence"), n.alias("candidate_count"), F.lit(6).alias("priority"))
    found = via.unionByName(suffix).unionByName(single).unionByName(many).unionByName(direct)
    best = found.groupBy("call_id").agg(F.min_by(F.struct("qualified_name", "strategy", "confidence", "candidate_count"), F.struct("priority", "qualified_name")).alias("b"))
    out = calls.select("call_id").join(best.select("call_id", "b.*"), "call_id", "left")
    return out.select("call_id", F.coalesce("qualified_name", F.lit("")).alias("qualified_name"), F.coalesce("strategy", F.lit("")).alias("strategy"), F.round(F.coalesce("confidence", F.lit(0.0)), 6).alias("confidence"), F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"))


def fuzzy_resolve(calls: DataFrame, registry: DataFrame) -> DataFrame:
    """(call_id, qualified_name, confidence): by simple name alone, halved if imports are given and none reaches it."""
    reg = _crowds(registry, "n").select("project", "simple", "seq", "qualified_name", "n")
    met = _named(calls).withColumn("simple", simple_name(F.col("callee"))).join(reg, ["project", "simple"])
    met = met.withColumn("reach", _reachable(F.col("import_vals"), F.col("qualified_name")))
    w = Window.partitionBy("call_id").orderBy(F.desc("reach"), F.desc(_score(F.col("qualified_name"), F.col("module_qn"))), "seq")
    top = met.withColumn("k", F.row_number().over(w)).where("k = 1")
    base = F.when(F.col("n") == 1, CONFIDENCE["fuzzy_single"]).otherwise(CONFIDENCE["fuzzy_multi"])
    halved = (F.size("import_vals") > 0) & ~F.col("reach")
    return top.select("call_id", "qualified_name", F.when(halved, base / 2).otherwise(base).alias("confidence"))
