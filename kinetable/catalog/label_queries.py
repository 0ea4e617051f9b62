"""Labels, taxonomy, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable import dims
from kinetable.catalog.adapters import CLIP_PATHS, clip_paths, table
from kinetable.catalog.registry import query, with_tables
from kinetable.operators import labels, splits


def _case(text: str, rules) -> str:
    arms = " ".join(f"WHEN contains({text}, '{word}') THEN {value}" for word, value in rules)
    return f"CASE {arms} END"


_EVENT_INDEX = {name: i for i, name in enumerate(dims.EVENT_ACTIONS)}
_EVENT_RULES = [(w, _EVENT_INDEX[n]) for w, n in dims.EVENT_KEYWORDS]
_EVENT_RULES += [(n, i) for i, n in enumerate(dims.EVENT_ACTIONS)]
_EVENT_CASE = _case("lower(path)", _EVENT_RULES)
_NAMES = "[" + ",".join(f"'{n}'" for n in dims.EVENT_ACTIONS) + "]"
_STEM = "lower(replace(regexp_extract(path, '[^/]*$'), '.npz', ''))"
_TAIL = f"regexp_extract({_STEM}, '[^_]*$')"
_FILE_CASE = _case(_STEM, [(w, i) for i, w in enumerate(dims.INTERACTION_CLASSES)])
_FLAG_CASE = _case(
    _STEM,
    [(w, 1) for w in dims.INTERACTION_AGGRESSIVE] + [(w, 0) for w in dims.INTERACTION_NEUTRAL],
)
_FLAG = (
    f"coalesce({_FLAG_CASE}, CASE WHEN try_cast({_TAIL} AS bigint) IN (2,4,5) THEN 1 "
    f"WHEN try_cast({_TAIL} AS bigint) IN (0,1,3) THEN 0 END)"
)
_BINARY = (
    "coalesce(cast(aggressive AS int), "
    f"CASE WHEN coalesce(dataset, '') IN ('ut_interaction', '') THEN {_FLAG} END)"
)


def _known(df):
    """NULL labels shown as -1 / unknown, so that results hold no nullable numbers."""
    return df.select(
        *[c for c in df.columns if c not in ("label", "label_name", "aggressive")],
        F.coalesce("label", F.lit(-1)).alias("label"),
        F.coalesce("label_name", F.lit("unknown")).alias("label_name"),
        F.coalesce(F.col("aggressive").cast("int"), F.lit(-1)).alias("aggressive"),
    )


@query(
    "label_keyword",
    with_tables(CLIP_PATHS)
    + f"""SELECT p_partkey, coalesce(label, -1) AS label, coalesce({_NAMES}[label+1], 'unknown') AS label_name,
                 coalesce(cast(label < 6 AS int), -1) AS aggressive
          FROM (SELECT p_partkey, {_EVENT_CASE} AS label FROM cp)""",
)
def label_keyword(spark, sf):
    named = labels.event_label_columns(clip_paths(spark, sf).drop("aggressive"), "path")
    return _known(named.select("p_partkey", "label", "label_name", "aggressive"))


@query(
    "label_filename",
    with_tables(CLIP_PATHS)
    + f"""SELECT p_partkey, cast(coalesce({_FILE_CASE}, try_cast({_TAIL} AS bigint), 0) AS bigint) AS label FROM cp""",
)
def label_filename(spark, sf):
    return clip_paths(spark, sf).select("p_partkey", labels.filename_label(F.col("path")).alias("label"))


@query(
    "label_explicit_wins",
    with_tables(CLIP_PATHS)
    + f"""SELECT p_partkey, cast(coalesce(cast(aggressive AS int), {_FILE_CASE}, try_cast({_TAIL} AS bigint), 0)
                  AS bigint) AS label FROM cp""",
)
def label_explicit_wins(spark, sf):
    stored = F.col("aggressive").cast("int")
    return clip_paths(spark, sf).select(
        "p_partkey", labels.clip_label(stored, F.col("path")).alias("label")
    )


@query("label_interaction_flag", with_tables(CLIP_PATHS) + f"SELECT p_partkey, coalesce({_FLAG}, -1) AS flag FROM cp")
def label_interaction_flag(spark, sf):
    return clip_paths(spark, sf).select("p_partkey", F.coalesce(labels.interaction_flag(F.col("path")), F.lit(-1)).alias("flag"))


@query("label_binary", with_tables(CLIP_PATHS) + f"SELECT p_partkey, coalesce({_BINARY}, -1) AS label FROM cp")
def label_binary(spark, sf):
    label = labels.binary_label(F.col("aggressive"), F.col("path"), F.col("dataset"))
    return clip_paths(spark, sf).select("p_partkey", F.coalesce(label, F.lit(-1)).alias("label"))


@query(
    "pooled_union",
    with_tables(CLIP_PATHS)
    + f"SELECT * FROM (SELECT p_partkey, dataset, {_BINARY} AS label FROM cp) WHERE label IS NOT NULL",
)
def pooled_union(spark, sf):
    paths = clip_paths(spark, sf)
    specs = [
        (name, paths.filter(F.col("dataset") == name).drop("dataset"))
        for name in ("ut_interaction", "set_b", "set_c")
    ]
    return labels.pooled(specs, path="path").select(
        "p_partkey", "dataset", F.col("binary").alias("label")
    )


_RANKED = """
hashed AS (SELECT p_partkey, md5('42#' || cast(p_partkey AS varchar)) AS h FROM part),
ranked AS (SELECT p_partkey, row_number() OVER (ORDER BY h, p_partkey) - 1 AS rk, count(*) OVER () AS n FROM hashed)"""


@query(
    "split_assign",
    with_tables(_RANKED)
    + """SELECT p_partkey, CASE WHEN rk < floor(n*0.15::double) THEN 'test'
                WHEN rk < floor(n*0.15::double) + floor(n*0.15::double) THEN 'val' ELSE 'train' END AS split FROM ranked""",
)
def split_assign(spark, sf):
    return splits.assign_split(table(spark, sf, "part").select("p_partkey"), "p_partkey")


@query(
    "split_holdout",
    with_tables(_RANKED)
    + """SELECT p_partkey, CASE WHEN rk < greatest(floor(n*0.2::double), 1) THEN 'val' ELSE 'train' END AS split FROM ranked""",
)
def split_holdout(spark, sf):
    return splits.assign_holdout(table(spark, sf, "part").select("p_partkey"), "p_partkey")


@query(
    "split_select_test",
    with_tables(_RANKED) + "SELECT p_partkey FROM ranked WHERE rk < floor(n*0.15::double)",
)
def split_select_test(spark, sf):
    items = splits.assign_split(table(spark, sf, "part").select("p_partkey"), "p_partkey")
    return splits.select_split(items, "test").select("p_partkey")


_CLASS_VALUES = ",".join(
    f"({a},{i},'{n}','{t}',{str(t == 'aggressive').lower()})"
    for i, (a, n, t) in enumerate(
        [(a, n, t) for t, m in (("aggressive", dims.DEPTH_AGGRESSIVE), ("subtle", dims.DEPTH_SUBTLE),
                                ("neutral", dims.DEPTH_NEUTRAL)) for a, n in m]
    )
)


@query(
    "class_dimension_join",
    f"""WITH c(action, label, label_name, tier, aggressive) AS (VALUES {_CLASS_VALUES})
        SELECT p_partkey, cast(p_partkey%120 AS int) AS action, cast(coalesce(label, -1) AS int) AS label,
               coalesce(label_name, 'unknown') AS label_name, coalesce(cast(aggressive AS int), -1) AS aggressive
        FROM part LEFT JOIN c ON p_partkey%120 = action""",
)
def class_dimension_join(spark, sf):
    clips = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 120).cast("int").alias("action"))
    return _known(labels.attach_depth_labels(clips)).select(
        "p_partkey", "action", "label", "label_name", "aggressive"
    )
