"""Registered queries over the driver's tables, and their DuckDB equivalents.

The tables stand in for robot data: a user of ``events`` is an episode and each event a
frame on its clock, a conversation is an episode of turns, an embedding holds 48 state
numbers and 16 of a camera, ``pages`` and ``documents`` stand for file listings.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import geometry as G
from ..functions.columns import file_uri, finite, gather, last, list_join, named, parent_dir, stem, with_suffix
from ..functions.sampling import sample_indexes
from ..operators import metrics, segments
from ..operators.hands import model_output_to_hands, register_method, track_hands
from ..operators.matching import match_hands
from ..operators.rewards import score_rewards
from ..sources import episodes, frame_datasets
from ..sources.readers import NpzDecoder, NpzReader
from ..sources.schemas import HAND
from . import sample_release

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- frames on a clock -----------------------------------------------------------------


def _micros() -> Column:
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id, t (seconds), value."""
    return _table(spark, sf_dir, "events").select("user_id", "event_id", (_micros() / F.lit(1e6)).alias("t"), "value")


def _bounded(frames: DataFrame) -> DataFrame:
    """Adds from_ts and to_ts, the middle half of each user's time, in the pass that puts a user's frames side by side."""
    user = W.partitionBy("user_id")
    low, high = F.min("t").over(user), F.max("t").over(user)
    return frames.withColumns({"from_ts": low + (high - low) * 0.25, "to_ts": low + (high - low) * 0.75})


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of the middle half with index, timestamp_s and length; one shuffle, by user."""
    got = segments.on_clock(_bounded(_frames(spark, sf_dir)), key="user_id", time="t", from_ts="from_ts", to_ts="to_ts")
    return got.withColumn("length", F.count("*").over(W.partitionBy("user_id")))


_FRAMES_SQL = """f AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, value FROM events),
b AS (SELECT user_id, min(t) + (max(t) - min(t)) * 0.25 AS from_ts, min(t) + (max(t) - min(t)) * 0.75 AS to_ts FROM f GROUP BY user_id),
s AS (SELECT f.user_id, event_id, t, value, row_number() OVER (PARTITION BY f.user_id ORDER BY t) - 1 AS index
      FROM f JOIN b USING (user_id) WHERE t >= from_ts - 1e-6 AND t < to_ts - 1e-6)"""


def _sample_sql(n: str, m: int) -> str:
    spread = f"list_distinct(list_transform(range(0, {m}), lambda i: round_even(i * ({n} - 1) / {max(1, m - 1)}.0, 0)::BIGINT))"
    return f"CASE WHEN {n} <= {m} THEN range(0, {n}) ELSE {spread if m > 1 else f'[{n} - 1]'} END"


def _sampled_lengths(spark: SparkSession, sf_dir: str, m: int) -> DataFrame:
    lengths = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return lengths.select("conv_id", "n", F.explode(sample_indexes("n", m)).alias("index"))


def _sampled_sql(m: int) -> str:
    return f"SELECT conv_id, n, unnest({_sample_sql('n', m)}) AS index FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)"


@query(f"SELECT user_id, n, unnest({_sample_sql('n', 8)}) AS index FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)")
def sample_indexes_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return lengths.select("user_id", "n", F.explode(sample_indexes("n", 8)).alias("index"))


@query(_sampled_sql(8))
def sample_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled_lengths(spark, sf_dir, 8)


@query(_sampled_sql(1))
def sample_max1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled_lengths(spark, sf_dir, 1)


@query(_sampled_sql(3))
def sample_m3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled_lengths(spark, sf_dir, 3)


@query(f"WITH {_FRAMES_SQL} SELECT user_id, event_id, index, t AS timestamp_s FROM s")
def segment_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).select("user_id", "event_id", "index", "timestamp_s")


@query(
    f"WITH {_FRAMES_SQL}, l AS (SELECT user_id, count(*) AS n FROM s GROUP BY user_id), w AS (SELECT user_id, unnest({_sample_sql('n', 8)}) AS index FROM l) "
    "SELECT s.user_id, s.event_id, s.index, s.t AS timestamp_s FROM s JOIN w ON s.user_id = w.user_id AND s.index = w.index"
)
def sampled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.sampled(_placed(spark, sf_dir), length="length").select("user_id", "event_id", "index", "timestamp_s")


def _rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id and a rewards struct: values of the user's events in order of time."""
    frames = _frames(spark, sf_dir).withColumn("index", F.row_number().over(W.partitionBy("user_id").orderBy("t", "event_id")) - 1)
    rows = frames.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("index", "t", "value"))).alias("x"))
    of = lambda f: F.transform("x", f)
    return rows.select("user_id", F.struct(of(lambda r: r["value"]).alias("reward_score"), of(lambda r: r["value"] / 100).alias("robometer_success"), of(lambda r: F.struct(r["index"].cast("long").alias("index"), r["t"].alias("timestamp_s"))).alias("reward_frames")).alias("rewards"))


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS index, round(epoch_us(ts) / 1e6, 3) AS timestamp_s, value AS reward_score FROM events")
def reward_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.reward_curve(_rewards(spark, sf_dir), keep=("user_id",)).withColumn("timestamp_s", F.round("timestamp_s", 3))


@query("SELECT user_id, round(success, 6) AS success FROM (SELECT user_id, last(value / 100 ORDER BY ts, event_id) AS success FROM events GROUP BY user_id) WHERE success < 0.5")
def quality_gate_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.doubtful(_rewards(spark, sf_dir)).select("user_id", F.round(last(F.col("rewards.robometer_success")), 6).alias("success"))


@query("SELECT conv_id, string_agg(role, '; ' ORDER BY turn) AS task FROM conversations GROUP BY conv_id")
def task_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return tasks.select("conv_id", list_join(F.col("x.role")).alias("task"))


# -- listings and predicates -----------------------------------------------------------


@query("SELECT page_id, string_split(url, '/')[-2] AS task, string_split(string_split(url, '/')[-1], '.')[1] AS name FROM pages")
def url_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", parent_dir("url").alias("task"), stem("url").alias("name"))


@query("SELECT page_id, TRY_CAST(regexp_extract(string_split(string_split(url, '/')[-1], '.')[1], '^[0-9]+$') AS BIGINT) AS episode_id FROM pages")
def episode_id_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.regexp_extract(stem("url"), "^[0-9]+$", 0)
    return _table(spark, sf_dir, "pages").select("page_id", name.try_cast("long").alias("episode_id"))


@query(r"SELECT page_id, regexp_replace(url, '\.html$', '.mp4') AS video FROM pages")
def sibling_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", with_suffix("url", ".html", ".mp4").alias("video"))


_LABELLED_SQL = "documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(_table(spark, sf_dir, "labels"), "doc_id", "left")


@query(f"SELECT d.doc_id, l.doc_id AS sibling, quality FROM {_LABELLED_SQL}")
def sibling_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sibling"), "quality")
    return docs.join(labels, docs.doc_id == labels.sibling, "left")


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr')")
def filter_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").where(F.col("lang").isin(["de", "fr"])).select("doc_id", "lang")


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('de', 'fr') AND source IN ('src1', 'src2')")
def filter_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").where(F.col("lang").isin(["de", "fr"])).where(F.col("source").isin(["src1", "src2"])).select("doc_id", "lang", "source")


@query("SELECT doc_id, lang FROM documents WHERE false")
def filter_empty_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").where(F.col("lang").isin([])).select("doc_id", "lang")


@query(f"SELECT d.doc_id, quality FROM {_LABELLED_SQL} WHERE quality IS NOT NULL")
def not_null_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).where(F.col("quality").isNotNull()).select("doc_id", "quality")


@query(f"SELECT d.doc_id, CASE WHEN quality = 1 THEN source END AS kept_source FROM {_LABELLED_SQL}")
def when_otherwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("doc_id", F.when(F.col("quality") == 1, F.col("source")).otherwise(F.lit(None)).alias("kept_source"))


@query("SELECT o_orderkey, round(o_totalprice * 2, 2) AS doubled FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25)")
def topk_then_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)
    return top.select("o_orderkey", F.round(F.col("o_totalprice") * 2, 2).alias("doubled"))


# -- hands -----------------------------------------------------------------------------

_SIX_SQL = "list_transform([0, 4, 8, 12, 16, 20], lambda k: [v[2 * k + 1], v[2 * k + 2]])"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


_V_SQL = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


def _hand3(v: Column, side: int) -> Column:
    """Wrist and fingertips of a side, from numbers 24 * side on: three for the wrist, six unused, fifteen for the tips."""
    return F.transform(F.array(*(F.lit(24 * side + k) for k in (1, 10, 13, 16, 19, 22))), lambda i: F.slice(v, i, 3))


@query(f"WITH {_V_SQL} SELECT vec_id, k, round(v[2 * k + 1], 5) AS x, round(v[2 * k + 2], 5) AS y FROM v, (SELECT unnest([0, 4, 8, 12, 16, 20]) AS k)")
def keypoint_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.slice("v", k * 2 + 1, 2))
    six = gather(points, G.WRIST_AND_TIPS)
    rows = _vectors(spark, sf_dir).select("vec_id", F.posexplode(six).alias("p", "xy"))
    return rows.select("vec_id", (F.col("p") * 4).alias("k"), F.round(F.col("xy")[0], 5).alias("x"), F.round(F.col("xy")[1], 5).alias("y"))


def _norm_sql(side: int, name: str) -> str:
    """CTEs name_p (vec_id, k, x, y, z) and name (the same, normalised)."""
    firsts = ", ".join(f"({k}, {24 * side + s})" for k, s in enumerate((1, 10, 13, 16, 19, 22)))
    return (
        f"{name}_p AS (SELECT vec_id, k, v[s] - v[{24 * side + 1}] AS x, v[s + 1] - v[{24 * side + 2}] AS y, v[s + 2] - v[{24 * side + 3}] AS z FROM v, (VALUES {firsts}) AS t(k, s)),\n"
        f"{name}_r AS (SELECT vec_id, avg(sqrt(x * x + y * y + z * z)) + 1e-9 AS r FROM {name}_p WHERE k > 0 GROUP BY vec_id),\n"
        f"{name} AS (SELECT vec_id, k, x / r AS x, y / r AS y, z / r AS z FROM {name}_p JOIN {name}_r USING (vec_id))"
    )


@query(f"WITH {_V_SQL}, {_norm_sql(0, 'g')} SELECT vec_id, k, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM g")
def hand_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select("vec_id", F.posexplode(G.normalise_column(_hand3(F.col("v"), 0))).alias("k", "p"))
    return rows.select("vec_id", "k", *(F.round(F.col("p")[i], 5).alias(n) for i, n in enumerate("xyz")))


_PERMUTED_SQL = """q AS (SELECT a.k AS a, b.k AS b, c.k AS c, d.k AS d, e.k AS e FROM range(1, 6) a(k), range(1, 6) b(k), range(1, 6) c(k), range(1, 6) d(k), range(1, 6) e(k)
      WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5)"""


@query(
    f"""WITH {_V_SQL}, {_norm_sql(0, 'g')}, {_norm_sql(1, 'm')},
d AS (SELECT g.vec_id, g.k AS i, m.k AS j, sqrt((g.x - m.x) ** 2 + (g.y - m.y) ** 2 + (g.z - m.z) ** 2) AS d FROM g JOIN m USING (vec_id) WHERE g.k > 0 AND m.k > 0),
w AS (SELECT vec_id, map(list(i * 10 + j), list(d)) AS d FROM d GROUP BY vec_id), {_PERMUTED_SQL.replace("AS d,", "AS dd,")}
SELECT vec_id, round(min(w.d[10 + a] + w.d[20 + b] + w.d[30 + c] + w.d[40 + q.dd] + w.d[50 + e]) / 6, 5) AS pair_error FROM w, q GROUP BY vec_id"""
)
def pair_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean error between the left and the right hand of each state, fingertips assigned at least cost."""

    @F.arrow_udf("double")
    def error(v: pa.Array) -> pa.Array:
        state = np.array(v.to_pylist(), dtype=float).reshape(len(v), -1)
        return pa.array(G.tip_errors(G.hand_points(state, 0), G.hand_points(state, 1)).mean(axis=1))

    return _vectors(spark, sf_dir).select("vec_id", F.round(error("v"), 5).alias("pair_error"))


def _plan_hands(v: Column) -> Column:
    """One predicted hand, or two: 21 points in pixels from the numbers of a vector."""

    def one(start: int, label: str) -> Column:
        points = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.transform(F.slice(v, k * 2 + start, 2), lambda x: (x * 100).cast("float")))
        return F.struct(F.lit(label).alias("handedness"), F.lit(1.0).cast("float").alias("confidence"), points.alias("kp2d"), F.lit(None).cast("array<array<float>>").alias("kp3d"))

    return F.array(one(1, "left"), one(3, "right"))


def _camera() -> Column:
    """A camera 5 units behind the origin that looks along z."""
    return F.array(*(F.lit(float(x)) for x in (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, -5, 0, 0, 0, 1)))


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", "label", match_hands(_plan_hands(F.col("v")), F.slice("v", 1, 48), _camera()).alias("score"))


def _match_sql() -> str:
    """CTEs up to c (vec_id, side, pred, errors as a list of 6, cost) and best (the chosen pairing)."""
    firsts = lambda side: ", ".join(f"({k}, {24 * side + s})" for k, s in enumerate((1, 10, 13, 16, 19, 22)))
    truth = lambda side: f"SELECT vec_id, {side} AS side, k, 736.6339 * v[s] / (v[s + 2] + 5) + 960.0 AS x, 736.6339 * v[s + 1] / (v[s + 2] + 5) + 540.0 AS y, v[s + 2] + 5 AS z FROM v, (VALUES {firsts(side)}) AS t(k, s)"
    guess = lambda p: f"SELECT vec_id, {p} AS pred, n AS k, ((v[8 * n + {1 + 2 * p}] * 100)::FLOAT)::DOUBLE AS x, ((v[8 * n + {2 + 2 * p}] * 100)::FLOAT)::DOUBLE AS y FROM v, range(0, 6) AS t(n)"
    norm = lambda name, part: (
        f"{name}_m AS (SELECT p.vec_id, p.{part}, p.k, p.x - o.x AS x, p.y - o.y AS y FROM {name}_p p JOIN {name}_p o ON p.vec_id = o.vec_id AND p.{part} = o.{part} AND o.k = 0),\n"
        f"{name} AS (SELECT m.vec_id, m.{part}, k, x / r AS x, y / r AS y FROM {name}_m m JOIN (SELECT vec_id, {part}, avg(sqrt(x * x + y * y)) + 1e-9 AS r FROM {name}_m WHERE k > 0 GROUP BY vec_id, {part}) s ON m.vec_id = s.vec_id AND m.{part} = s.{part})"
    )
    return f"""{_V_SQL},
g_a AS ({truth(0)} UNION ALL {truth(1)}),
g_p AS (SELECT * FROM g_a WHERE (vec_id, side) NOT IN (SELECT vec_id, side FROM g_a WHERE z <= 0)),
m_p AS ({guess(0)} UNION ALL {guess(1)}),
{norm('g', 'side')},
{norm('m', 'pred')},
d AS (SELECT g.vec_id, g.side, m.pred, g.k AS i, m.k AS j, sqrt((g.x - m.x) ** 2 + (g.y - m.y) ** 2) AS d FROM g JOIN m USING (vec_id) WHERE g.k > 0 AND m.k > 0),
w AS (SELECT vec_id, side, pred, map(list(i * 10 + j), list(d)) AS d FROM d GROUP BY vec_id, side, pred),
{_PERMUTED_SQL.replace("AS d,", "AS dd,")},
o AS (SELECT vec_id, side, pred, [0.0, w.d[10 + a], w.d[20 + b], w.d[30 + c], w.d[40 + q.dd], w.d[50 + e]] AS errs FROM w, q),
c AS (SELECT vec_id, side, pred, arg_min(errs, list_sum(errs)) AS errs, min(list_sum(errs)) / 6 AS cost FROM o GROUP BY vec_id, side, pred),
n AS (SELECT vec_id, count(DISTINCT side) AS n_gt FROM g GROUP BY vec_id),
pairing AS (
  SELECT n.vec_id, n_gt, x.side AS s1, x.pred AS p1, y.side AS s2, y.pred AS p2, x.cost + coalesce(y.cost, 0) AS cost
  FROM n JOIN c x ON n.vec_id = x.vec_id LEFT JOIN c y ON n_gt = 2 AND y.vec_id = n.vec_id AND x.side = 0 AND y.side = 1 AND y.pred <> x.pred
  WHERE n_gt = 1 OR y.vec_id IS NOT NULL),
best AS (SELECT vec_id, arg_min(pairing, cost) AS p, min(cost) AS cost FROM pairing GROUP BY vec_id)"""


@query(
    f"WITH {_match_sql()} SELECT v.vec_id, coalesce(n_gt, 0)::BIGINT AS n_gt, coalesce(n_gt, 0)::BIGINT AS n_matched, round(cost / n_gt, 4) AS mean_cost "
    "FROM v LEFT JOIN n USING (vec_id) LEFT JOIN best USING (vec_id)"
)
def hand_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = F.aggregate(F.flatten("score.errs"), F.lit(0.0), lambda a, x: a + x) / F.size(F.flatten("score.errs"))
    return _matches(spark, sf_dir).select("vec_id", "score.n_gt", "score.n_matched", F.round(F.when(F.col("score.n_matched") > 0, mean), 4).alias("mean_cost"))


@query(
    f"""WITH {_match_sql()},
h AS (SELECT b.vec_id, c.errs FROM best b JOIN c ON c.vec_id = b.vec_id AND ((c.side = b.p.s1 AND c.pred = b.p.p1) OR (b.p.s2 IS NOT NULL AND c.side = b.p.s2 AND c.pred = b.p.p2))),
e AS (SELECT vec_id, unnest(errs) AS e FROM h),
a AS (SELECT label, sum(n_gt) AS gt FROM v JOIN n USING (vec_id) GROUP BY label),
k AS (SELECT label, avg(list_sum(errs) / 6) AS mean_err, count(*) AS hands FROM v JOIN h USING (vec_id) GROUP BY label),
p AS (SELECT label, 100.0 * avg((e < 0.1)::INT) AS p1, 100.0 * avg((e < 0.2)::INT) AS p2, 100.0 * avg((e < 0.3)::INT) AS p3 FROM v JOIN e USING (vec_id) GROUP BY label)
SELECT label, gt::BIGINT AS n_gt, hands::BIGINT AS n_matched, round(100.0 * hands / gt, 4) AS detect, round(mean_err, 4) AS mean_err, round(p1, 4) AS pck_0_1, round(p2, 4) AS pck_0_2, round(p3, 4) AS pck_0_3
FROM a JOIN k USING (label) JOIN p USING (label)"""
)
def detect_pck_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.report(_matches(spark, sf_dir))
    return got.select("label", "n_gt", "n_matched", *(F.round(c, 4).alias(c) for c in ("detect", "mean_err", "pck_0_1", "pck_0_2", "pck_0_3")))


@query(
    f"""WITH {_match_sql()}, f AS (SELECT v.vec_id, v.label % 2 = 0 AS even, n_gt FROM v LEFT JOIN n USING (vec_id)),
u AS (SELECT 'first' AS label, n_gt, true AS scored FROM f UNION ALL SELECT 'second', n_gt, even FROM f)
SELECT label, count(*)::BIGINT AS frames, count(*) FILTER (scored)::BIGINT AS scored, coalesce(sum(n_gt) FILTER (scored), 0)::BIGINT AS n_gt FROM u GROUP BY label"""
)
def methods_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two methods in rows; the second has no score on frames of odd label."""
    scored = _matches(spark, sf_dir).select("score", F.when(F.col("label") % 2 == 0, F.col("score")).alias("other"))
    rows = metrics.by_method(scored, {"first": "score", "second": "other"})
    return rows.groupBy("label").agg(F.count("*").alias("frames"), F.count("score").alias("scored"), F.coalesce(F.sum("score.n_gt"), F.lit(0).cast("long")).alias("n_gt"))


#: Turned about the upright axis by the angle of a 3-4-5 triangle, and moved.
_TURNED = np.array([[0.6, 0, 0.8, 0.1], [0, 1, 0, -0.2], [-0.8, 0, 0.6, -1.0], [0, 0, 0, 1]])


@query(
    f"WITH {_V_SQL}, c AS (SELECT vec_id, 0.6 * (v[1] - 0.1) - 0.8 * (v[3] + 1.0) AS x, v[2] + 0.2 AS y, 0.8 * (v[1] - 0.1) + 0.6 * (v[3] + 1.0) AS z FROM v) "
    "SELECT vec_id, CASE WHEN z > 0 THEN round(x / z * 736.6339 + 960.0, 3) END AS u, CASE WHEN z > 0 THEN round(y / z * 736.6339 + 540.0, 3) END AS v FROM c"
)
def pinhole_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three numbers of a vector as a point in the world, in pixels of a turned and moved camera."""
    kind = pa.list_(pa.float64())

    @F.arrow_udf("array<double>")
    def pixels(v: pa.Array) -> pa.Array:
        points = np.array(v.to_pylist(), dtype=float).reshape(len(v), -1)[:, None, :3]
        uv = G.project_world(points, np.broadcast_to(_TURNED, (len(v), 4, 4)))[:, 0]
        return pa.array([None if np.isnan(p).any() else p.tolist() for p in uv], kind)

    seen = _vectors(spark, sf_dir).select("vec_id", pixels("v").alias("uv"))
    return seen.select("vec_id", F.round(F.col("uv")[0], 3).alias("u"), F.round(F.col("uv")[1], 3).alias("v"))


@query(
    "SELECT l_orderkey, l_linenumber, round((l_extendedprice - 1920.0 / 2) * 2 / (l_quantity * (l_tax + 1) + 1e-9) + l_discount, 4) AS tx, "
    "round((l_quantity * 10 - 1080.0 / 2) * 2 / (l_quantity * (l_tax + 1) + 1e-9) + l_tax, 4) AS ty, round(37500.0 * 2 / (l_quantity * (l_tax + 1) + 1e-9), 4) AS tz FROM lineitem"
)
def cam_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    t = G.full_image_camera_columns(c("l_tax") + 1, c("l_discount"), c("l_tax"), c("l_extendedprice"), c("l_quantity") * 10, c("l_quantity"), F.lit(1920.0), F.lit(1080.0), F.lit(37500.0))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.round(x, 4).alias(n) for n, x in t.items()))


@query(f"WITH {_V_SQL} SELECT vec_id, round((2 * (label % 2) - 1) * v[1], 5) AS x, round(v[2], 5) AS y, round((2 * (label % 2) - 1) * v[4], 5) AS next_x FROM v")
def mirror_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two points of a vector as a hand, mirrored where the label is even."""
    kind = pa.list_(pa.float64())

    @F.arrow_udf("array<double>")
    def turned(v: pa.Array, right: pa.Array) -> pa.Array:
        points = np.array(v.to_pylist(), dtype=float).reshape(len(v), -1)[:, :6].reshape(-1, 2, 3)
        return pa.array(G.mirrored(points, right.to_numpy(zero_copy_only=False)).reshape(len(v), 6).tolist(), kind)

    got = _vectors(spark, sf_dir).select("vec_id", turned("v", F.col("label") % 2).alias("p"))
    return got.select("vec_id", F.round(F.col("p")[0], 5).alias("x"), F.round(F.col("p")[1], 5).alias("y"), F.round(F.col("p")[3], 5).alias("next_x"))


@query("SELECT vec_id, vec_id % 5 NOT IN (1, 2, 3) AS finite FROM embeddings")
def finite_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that hold a NaN, an infinity or a null in one place, by their id, and those that don't."""
    kind = F.col("vec_id") % 5
    odd = F.when(kind == 1, F.lit(float("nan"))).when(kind == 2, F.lit(float("-inf")))
    broken = F.transform("v", lambda x, i: F.when((i == 3) & kind.isin([1, 2, 3]), odd).otherwise(x))
    return _vectors(spark, sf_dir).select("vec_id", finite(broken).alias("finite"))


class MeanHand:
    """A tracker without a model: one hand whose points step right from the image's mean grey, for tests and plans."""

    def __call__(self) -> MeanHand:
        return self

    def track(self, frames: list) -> list[list[dict]]:
        return [[] if f is None else [{"handedness": "right", "confidence": 1.0, "kp2d": [[float(f.mean()) + k, float(f.shape[0])] for k in range(21)], "kp3d": None}] for f in frames]

    def __hash__(self) -> int:
        return hash(MeanHand)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, MeanHand)


register_method("mean", MeanHand)


@query(
    """WITH b AS (SELECT doc_id, CASE WHEN text <> '' THEN octet_length(encode(text)) END AS n, hex(encode(text)) AS h FROM documents)
SELECT doc_id, (n IS NOT NULL)::BIGINT AS hands, n::DOUBLE AS y,
       round(CASE WHEN n IS NOT NULL THEN list_avg(list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::INT))::FLOAT::DOUBLE END, 2) AS x FROM b"""
)
def track_hands_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as a picture one pixel wide, null if it has no byte, through the tracking operator with a model-free method."""
    docs = _table(spark, sf_dir, "documents")
    grey = F.concat(*(F.col("text") for _ in range(3))).cast("binary")
    image = F.when(F.col("text") != "", F.struct(F.octet_length("text").alias("height"), F.lit(1).alias("width"), F.lit(3).alias("nChannels"), F.lit("RGB").alias("mode"), grey.alias("data")))
    point = F.get(F.col("hands"), 0)["kp2d"][0]
    tracked = docs.select("doc_id", track_hands(image, method="mean").alias("hands"))
    return tracked.select("doc_id", F.size("hands").cast("long").alias("hands"), point[1].cast("double").alias("y"), F.round(point[0].cast("double"), 2).alias("x"))


# -- files and a service ---------------------------------------------------------------

_RELEASE_SQL = "r AS (SELECT n_nationkey AS n, n_name, replace(lower(r_name), ' ', '_') AS task, 3 + n_nationkey % 11 AS frames, n_nationkey % 3 <> 0 AS filmed FROM nation JOIN region ON n_regionkey = r_regionkey)"
_NPZ = {"reader": NpzReader(), "suffix": ".npz"}


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.raw(spark, sample_release.release(spark, sf_dir), **_NPZ)


@query(f"WITH {_RELEASE_SQL} SELECT task, n::BIGINT AS episode_id, lower(n_name) AS description, n % 2 = 0 AS annotated, task || '/' || n || '.npz' AS file, CASE WHEN filmed THEN task || '/' || n || '.mp4' END AS video FROM r")
def catalog_fs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog of a release on disk."""
    tail = lambda c: F.array_join(F.slice(F.split(c, "/"), -2, 2), "/")
    return _catalog(spark, sf_dir).select("task", "episode_id", F.col("metadata.llm_description").alias("description"), F.col("metadata.annotated").alias("annotated"), tail("trajectory").alias("file"), tail("video").alias("video"))


@query(f"WITH {_RELEASE_SQL} SELECT task, n::BIGINT AS episode_id, frames::BIGINT AS frames, (16 * (frames * n + frames * (frames - 1) / 2))::DOUBLE AS total FROM r WHERE task IN ('asia', 'europe')")
def trajectory_fs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array of the episodes of two tasks; the other files aren't opened."""
    chosen = episodes.raw(spark, sample_release.release(spark, sf_dir), tasks=["asia", "europe"], **_NPZ)
    got = episodes.trajectory(chosen, [sample_release.PLACE], reader=NpzReader())
    flat = F.flatten(F.flatten(named(sample_release.PLACE)))
    return got.select("task", "episode_id", F.size(named(sample_release.PLACE)).cast("long").alias("frames"), F.aggregate(flat, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(
    f"WITH {_RELEASE_SQL}, f AS (SELECT task, n, unnest(range(0, frames, 2)) AS k FROM r WHERE filmed) "
    "SELECT task, n::BIGINT AS episode_id, (k // 2)::BIGINT AS frame, k / 10.0::DOUBLE AS timestamp_s, 2 AS height, 6 AS width, ((n * 7 + k * 5) % 256)::BIGINT AS grey FROM f WHERE k < 8"
)
def camera_frames_fs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second frame of the first 0.8 s of each video, twice as wide, one row a frame."""
    got = episodes.frame_rows(_catalog(spark, sf_dir), decoder=NpzDecoder(), width=6, sample_interval_seconds=0.2, end_time=0.8)
    return got.select("task", "episode_id", "frame", "timestamp_s", "image.height", "image.width", F.conv(F.hex(F.substring("image.data", 1, 1)), 16, 10).cast("long").alias("grey"))


@query(
    f"WITH {_RELEASE_SQL}, i AS (SELECT task, n, unnest({_sample_sql('frames', 8)}) AS k, least(frames, 8) AS m FROM r WHERE filmed) "
    "SELECT task, n::BIGINT AS episode_id, k::BIGINT AS index, k / 10.0::DOUBLE AS timestamp_s, round(row_number() OVER (PARTITION BY n ORDER BY k) / m, 6) AS reward_score, round(((n * 7 + k * 5) % 256) / 255, 6) AS success FROM i"
)
def score_rewards_fake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled frames of each video scored by a stand-in server, one row a frame."""
    filmed = _catalog(spark, sf_dir).where("video IS NOT NULL").select("task", "episode_id", "video", (F.col("episode_id") % 11 + 3).alias("length"))
    scored = filmed.withColumn("rewards", score_rewards("task", "length", F.lit(0.0), F.lit(10.0), "video", url=sample_release.fake_server(spark), decoder=NpzDecoder()))
    rows = scored.select("task", "episode_id", F.posexplode(F.arrays_zip("rewards.reward_frames", "rewards.reward_score", "rewards.robometer_success")).alias("place", "x"))
    return rows.select("task", "episode_id", "x.reward_frames.index", "x.reward_frames.timestamp_s", F.round("x.reward_score", 6).alias("reward_score"), F.round("x.robometer_success", 6).alias("success"))


@query(
    f"WITH {_RELEASE_SQL}, f AS (SELECT n, unnest(range(0, frames)) AS k FROM r) "
    "SELECT n::BIGINT AS episode_index, k::BIGINT AS frame_index, k / 10.0::DOUBLE AS timestamp, 2 AS height, ((n * 7 + k * 5) % 256)::BIGINT AS grey FROM f"
)
def frame_dataset_fs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of a robot dataset on disk, each with its image out of a video that several episodes share."""
    rows = frame_datasets.read(spark, sample_release.frame_dataset(spark, sf_dir), load_video_frames="cam.top", decoder=NpzDecoder())
    image = named("cam.top")
    return rows.select("episode_index", "frame_index", "timestamp", image["height"].alias("height"), F.conv(F.hex(F.substring(image["data"], 1, 1)), 16, 10).cast("long").alias("grey"))


@query(
    """WITH n AS (SELECT n_nationkey AS n, n_regionkey AS r, n_name, 3 + n_nationkey % 11 AS frames FROM nation),
e AS (SELECT *, coalesce(sum(frames) OVER (PARTITION BY r ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM n)
SELECT n::BIGINT AS episode_index, lower(n_name) || '; go on' AS task, frames::BIGINT AS length, 'file-00' || r || '.mp4' AS file, (begin / 10)::DOUBLE AS from_ts, ((begin + frames) / 10)::DOUBLE AS to_ts FROM e"""
)
def frame_dataset_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its episodes, with the video that holds each and where."""
    rows = frame_datasets.read_episodes(spark, sample_release.frame_dataset(spark, sf_dir), include_video_metadata=True)
    of = lambda x: named(f"videos/cam.top/{x}")
    return rows.select("episode_index", list_join("tasks").alias("task"), "length", F.element_at(F.split(of("video"), "/"), -1).alias("file"), of("from_timestamp").alias("from_ts"), of("to_timestamp").alias("to_ts"))


@query(
    f"WITH {_V_SQL}, p AS (SELECT vec_id, v, 2 * (label % 2) - 1 AS s, v[3] + 1000.0 / (100 + 1e-9) AS z FROM v) "
    "SELECT vec_id, CASE WHEN s = 1 THEN 'right' ELSE 'left' END AS handedness, round((500 * (s * v[1] + s * v[4]) / z + 320)::FLOAT::DOUBLE, 2) AS x, "
    "round((500 * (v[2] + v[5]) / z + 240)::FLOAT::DOUBLE, 2) AS y, round((s * v[1])::FLOAT::DOUBLE, 4) AS kp3d_x FROM p"
)
def mesh_hands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point and a crop camera of a mesh model, from the numbers of a vector, as a hand in the full image; left ones are un-mirrored."""
    kind = to_arrow_type(HAND)

    @F.arrow_udf(HAND)
    def placed(v: pa.Array, right: pa.Array) -> pa.Array:
        x, n = np.array(v.to_pylist(), dtype=float).reshape(len(v), -1), len(v)
        cameras = np.column_stack([np.ones(n), x[:, 3:5]])
        hands = model_output_to_hands(right.to_numpy(zero_copy_only=False), np.full(n, 0.9), cameras, x[:, None, :3], np.tile([320.0, 240.0], (n, 1)), np.full(n, 100.0), np.array([640.0, 480.0]), 500.0)
        return pa.array(hands, kind)

    got = _vectors(spark, sf_dir).select("vec_id", placed("v", F.col("label") % 2).alias("h"))
    at = lambda c, k: F.round(F.col(f"h.{c}")[0][k].cast("double"), 4 if c == "kp3d" else 2)
    return got.select("vec_id", "h.handedness", at("kp2d", 0).alias("x"), at("kp2d", 1).alias("y"), at("kp3d", 0).alias("kp3d_x"))


@query(r"""SELECT page_id, regexp_replace('file:' || path, '^(file:/+|/)', 'file:///') AS one, regexp_replace(path, '^(file:/+|/)', 'file:///') AS two, url AS three
FROM (SELECT page_id, url, regexp_replace(url, '^[a-z]+://', '/') AS path FROM pages)""")
def file_uri_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as Spark and as the shell write them in the one form of the catalog; other schemes stay."""
    path = F.regexp_replace("url", "^[a-z]+://", "/")
    return _table(spark, sf_dir, "pages").select("page_id", file_uri(F.concat(F.lit("file:"), path)).alias("one"), file_uri(path).alias("two"), file_uri("url").alias("three"))


@query("SELECT c_custkey, c_custkey AS again, c_nationkey::BIGINT + 1 AS next FROM customer")
def strict_cast_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text cast to numbers, where text that isn't one would fail; a struct taken apart and a column left out."""
    held = _table(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_custkey").cast("string").alias("again"), (F.col("c_nationkey").cast("long") + 1).alias("next")).alias("s"))
    return held.select("c_custkey", "s.*").select("c_custkey", F.col("again").cast(held.schema["c_custkey"].dataType).alias("again"), "next")
