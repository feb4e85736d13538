"""License scans: MinHash bands over text windows retrieve templates, exact containment verifies them.

A text is read as lower-case runs of a-z and 0-9; a shingle is two words in a row. Windows
of ``WINDOW`` words start every ``STEP`` words; templates are cut into segments of at most
``WINDOW - STEP + 1`` words, so each segment of a passage lies whole in some window. A band
is one MinHash: shingle hashes are compared by their distance, in the order of bits, to a
random number of the band, and the nearest one is the band's value. Two sets agree in a band
with the chance of their resemblance. A window holds at most ``WINDOW - 1`` shingles and a
segment of ``s`` words s - 1 of them, so their resemblance is at least (s - 1) / (WINDOW - 1),
or 4/10 with one of five shingles broken; with ``BANDS`` bands the chance to miss a segment
is below 0.6 ** 24 < 5e-6. A match keeps ``CONTAINED`` of a template's shingles, so on
average no segment lacks more than 1.2 of them, and several have to be missed at once.

A retrieved template is held against the whole text first: it needs ``CONTAINED`` of the
template's distinct shingles. Then against the regions that begin where the retrieved
windows put the template's first word, or a step to either side, and are ``WINDOW`` words
longer than it; a match is a region with that share. Everything is DataFrame functions. Every
window of every text is looked at; one without any shingle of any template has resemblance
0 to all segments and can't agree with one in any band, so its bands aren't computed.

Defined results: null, empty and one-word texts match nothing; a match is a row of its
document, with its greatest containment and, of equal ones, the first region; documents with
null or shared ids are told apart and have a row each; a text of any length is read whole; an
empty table gives an empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import TEMPLATES
from .workspace import clear_of, named

WINDOW, STEP, BANDS = 10, 5, 24
SEGMENT = WINDOW - STEP + 1
CONTAINED = 0.8
_DRAW = random.Random(97)
_NEAR = [_DRAW.getrandbits(64) - (1 << 63) for _ in range(BANDS)]


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")


def _shingles(words: Column) -> Column:
    """Hashes of the two-word shingles of an array of words, in order."""
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))


def _apart(shingles: Column, band: int) -> Column:
    """Distance of each shingle to the band's number; of a set, the least one is the band's value."""
    return F.transform(shingles, lambda x: x.bitwiseXOR(F.lit(_NEAR[band])))


def _templates(spark: SparkSession, templates: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(license, m, all) with all shingles, and (band, value, license, offset) of the segments. Both are of the size of the given list."""
    rows = [(k, words) for k, t in templates.items() if len(words := words_of(t)) > 1]
    base = spark.createDataFrame(rows, "license string, words array<string>").withColumn("sh", _shingles(F.col("words")))
    whole = base.select("license", F.size("words").alias("m"), F.array_distinct("sh").alias("all"))
    last = F.greatest(F.size("words") - SEGMENT, F.lit(0))
    at = F.array_distinct(F.concat(F.filter(F.sequence(F.lit(0), last, F.lit(SEGMENT)), lambda x: x <= last), F.array(last)))
    cut = base.select("license", "sh", F.explode(at).alias("offset"))
    mine = F.slice("sh", F.col("offset") + 1, F.lit(SEGMENT - 1))
    bands = cut.select("license", "offset", F.posexplode(F.array(*(F.array_min(_apart(mine, b)) for b in range(BANDS)))).alias("band", "value"))
    return whole, bands


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, *, id_col: str = "doc_id", text_col: str = "text", contained: float = CONTAINED) -> DataFrame:
    """One row per document and template found in it: id, license, containment, word (where the region of the best match begins)."""
    clear_of(docs, id_col, text_col)
    whole, bands = _templates(docs.sparkSession, templates)
    segments, shapes = bands.collect(), whole.collect()  # of the given list
    known, wanted = sorted({x for r in shapes for x in r.all}), sorted({r.value for r in segments})
    of_a_template = lambda x: x.isin(known)
    ident, text = named(id_col), named(text_col)
    texts = docs.where(text.isNotNull()).select(ident.alias("id"), F.monotonically_increasing_id().alias("row"), _shingles(_words(text)).alias("sh"))
    texts = texts.select("*", F.array_distinct(F.filter("sh", of_a_template)).alias("shared")).where(F.size("shared") > 0)
    window = lambda i: F.slice("sh", i + 1, F.lit(WINDOW - 1))
    places = F.filter(F.sequence(F.lit(0), F.size("sh") - 1, F.lit(STEP)), lambda i: F.exists(window(i), of_a_template))
    values = lambda i: F.array(*(F.array_min(_apart(window(i), b)) for b in range(BANDS)))
    probes = F.flatten(F.transform(places, lambda i: F.transform(F.filter(values(i), lambda v: v.isin(wanted)), lambda v: F.struct(i.alias("at"), v.alias("value")))))
    hits = texts.select("*", F.explode(probes).alias("hit")).select("id", "row", "sh", "shared", "hit.at", "hit.value")
    need = contained * F.size("all") - F.lit(1e-9)
    begin = (F.floor(F.greatest(F.col("at") - F.col("offset"), F.lit(0)) / STEP) * STEP).cast("int")
    # the whole text has to hold enough of a template; what it doesn't share with any template is of no help
    near = hits.join(F.broadcast(bands.drop("band")), "value").join(F.broadcast(whole), "license").where((F.size("shared") >= need) & (F.size(F.array_intersect("all", "shared")) >= need))
    met = near.groupBy("row", "license").agg(F.first("id").alias("id"), F.first("sh").alias("sh"), F.first("m").alias("m"), F.first("all").alias("all"), F.collect_set(begin).alias("starts"))
    around = F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda x: F.filter(F.array(x - STEP, x, x + STEP), lambda y: (y >= 0) & (y < F.size("sh")))))))
    region = lambda x: F.slice("sh", x + 1, F.col("m") + WINDOW - 1)
    best = F.array_max(F.transform(around, lambda x: F.struct((F.size(F.array_intersect("all", region(x))) / F.size("all")).alias("containment"), (-x).alias("back"))))
    found = met.select("id", "license", best.alias("best")).where(F.col("best.containment") >= contained)
    return found.select(F.col("id").alias(id_col), "license", F.col("best.containment").alias("containment"), (-F.col("best.back")).alias("word"))


def _oracle() -> str:
    """DuckDB: every region of every text against every template that the whole text holds enough of."""
    values = ",\n  ".join(f"('{k}', {words_of(t)!r})" for k, t in TEMPLATES.items())
    return rf"""
WITH t(license, w) AS (VALUES
  {values}),
s AS (SELECT license, len(w) AS m, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS allsh FROM t),
d AS (SELECT row_number() OVER () AS row, doc_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT row, doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS sh FROM d WHERE len(w) > 1),
k AS (SELECT license, m, allsh, unnest(allsh) AS x FROM s),
e AS (SELECT DISTINCT row, unnest(sh) AS x FROM b),
n AS (SELECT row, license FROM e JOIN k USING (x) GROUP BY row, license, len(allsh) HAVING count(*) >= {CONTAINED} * len(allsh) - 1e-9),
p AS (SELECT n.row, b.doc_id, license, allsh, b.sh[r + 1 : r + m + {WINDOW} - 1] AS region
      FROM n JOIN s USING (license) JOIN b ON n.row = b.row, unnest(range(0, len(b.sh), {STEP})) AS u(r)),
c AS (SELECT row, doc_id, license, len(list_intersect(allsh, region)) / len(allsh) AS containment FROM p)
SELECT doc_id, license, max(containment) AS containment FROM c WHERE containment >= {CONTAINED} GROUP BY row, doc_id, license
"""


ORACLE = _oracle()
