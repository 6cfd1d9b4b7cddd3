"""Licence notices found by Dice coefficient over word bigrams, in DataFrame functions only.

A text's words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ in lower case. Windows of a template's length are compared with it:
2 * common >= THRESHOLD * (the window's different bigrams + the template's). Sizes bound what can match: a text, or
a window at its end, of u bigrams only templates of THRESHOLD / (2 - THRESHOLD) * u to u * (2 - THRESHOLD) / THRESHOLD. As two
thirds of a template's bigrams must be in a window that matches (at 0.8), one of any third of them must: windows are anchored
where one of that many of its bigrams stands, those that fewest templates have, the longest first, and so that it stands
in the window where it stands in the template.

Of matching windows that overlap, the best counts: by Dice, then length, name and place. Each row is answered by itself, in
one pass without any shuffle: repeated and missing doc_ids don't matter. Null, empty and one-word texts match nothing; very long
texts are windows like all others; an empty table gives no rows.
"""

import json
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.llm.licence_texts import TEMPLATES

THRESHOLD = 0.8
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), GAP), "")


def template_rows(templates: dict[str, list[str]], threshold: float) -> list[dict]:
    """licence, sequence (bigrams in order), bigrams (different ones), anchors of each template of two words or more."""
    import re

    rows = []
    for licence, texts in templates.items():
        for t in texts:
            w = [x for x in re.split(GAP, t.lower()) if x]
            sequence = [f"{a} {b}" for a, b in zip(w, w[1:])]
            if sequence:
                rows.append({"licence": licence, "sequence": sequence, "bigrams": list(dict.fromkeys(sequence))})
    used = Counter(b for r in rows for b in r["bigrams"])
    for r in rows:
        n = len(r["bigrams"])
        # A window that matches lacks fewer than this many of the template's bigrams.
        lacks = n - int(-(-n * threshold // (2 - threshold))) + 1
        r["anchors"] = sorted(r["bigrams"], key=lambda b: (used[b], -len(b), b))[: max(1, lacks)]
    return rows


def notices(text: Column, templates: dict[str, list[str]], threshold: float) -> Column:
    """array<struct<licence, dice, first, end>>: places count words."""
    rows = template_rows(templates, threshold)
    struct = "struct<licence:string,sequence:array<string>,bigrams:array<string>,anchors:array<string>>"
    # Both fold to constants when the query is planned.
    table = F.from_json(F.lit(json.dumps(rows)), f"array<{struct}>")
    anchors = F.from_json(F.lit(json.dumps(sorted({a for r in rows for a in r["anchors"]}))), "array<string>")
    kind = "array<struct<rank:double,short:int,licence:string,first:int,end:int,dice:double>>"

    def windows(b: Column, present: Column, t: Column) -> Column:
        mine = F.array_intersect(t["anchors"], present)
        places = F.filter(F.transform(b, lambda x, i: F.when(F.array_contains(mine, x), F.greatest(i - F.array_position(t["sequence"], x).cast("int") + 1, F.lit(0)))), lambda i: i.isNotNull())

        def compared(first: Column) -> Column:
            window = F.slice(b, first + 1, F.size(t["sequence"]))
            distinct = F.array_distinct(window)
            dice = 2.0 * F.size(F.array_intersect(distinct, t["bigrams"])) / (F.size(distinct) + F.size(t["bigrams"]))
            return F.struct((-dice).alias("rank"), (-F.size(t["sequence"])).alias("short"), t["licence"].alias("licence"), first.alias("first"), (first + F.size(window) + 1).alias("end"), dice.alias("dice"))

        return F.filter(F.transform(F.array_distinct(places), compared), lambda m: m["dice"] >= threshold)

    def found(b: Column, present: Column) -> Column:
        large = lambda t: F.size(b) * (2 - threshold) >= F.size(t["bigrams"]) * threshold
        able = F.filter(table, lambda t: large(t) & F.arrays_overlap(t["anchors"], present))
        matches = F.array_sort(F.flatten(F.transform(able, lambda t: windows(b, present, t))))
        free = lambda kept, m: ~F.exists(kept, lambda k: (k["first"] < m["end"]) & (m["first"] < k["end"]))
        return F.aggregate(matches, F.array().cast(kind), lambda kept, m: F.when(free(kept, m), F.concat(kept, F.array(m))).otherwise(kept))

    none = F.array().cast(kind)
    pairs = lambda w: F.when(F.size(w) >= 2, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat(F.get(w, i - 1), F.lit(" "), F.get(w, i)))).otherwise(F.array().cast("array<string>"))
    # A transform over one element names a value that is used several times; it's made once.
    once = lambda value, use: F.get(F.transform(F.array(value), use), 0)
    return once(words(F.coalesce(text, F.lit(""))), lambda w: once(pairs(w), lambda b: once(
        F.array_intersect(b, anchors), lambda present: F.when(F.size(present) > 0, found(b, present)).otherwise(none))))


def licence_scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_notices, licences (names, sorted, comma-joined), best_dice (null: none), notices."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), notices(F.col("text").cast("string"), templates or TEMPLATES, threshold).alias("m"))
    return out.select(
        "doc_id", F.size("m").cast("long").alias("n_notices"), F.array_join(F.sort_array(F.array_distinct("m.licence")), ",").alias("licences"),
        F.round(F.array_max("m.dice"), 6).alias("best_dice"), F.transform("m", lambda x: F.struct(x["licence"].alias("licence"), x["dice"].alias("dice"), x["first"].alias("first"), x["end"].alias("end"))).alias("notices"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_notices", "licences", "best_dice")


def _sql() -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    array = lambda xs: "[" + ", ".join(map(text, xs)) + "]"
    rows = ", ".join(f"({i}, {text(r['licence'])}, {array(r['sequence'])}, {array(r['bigrams'])}, {array(r['anchors'])})" for i, r in enumerate(template_rows(TEMPLATES, THRESHOLD)))
    return rf"""
WITH t(id, licence, sequence, bigrams, anchors) AS (VALUES {rows}),
a AS (SELECT id, anchor, list_position(sequence, anchor) - 1 AS place FROM (SELECT id, sequence, unnest(anchors) AS anchor FROM t)),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x != '') AS w FROM documents),
p AS (SELECT r, doc_id, CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END AS b FROM d),
u AS (SELECT r, unnest(b) AS x, unnest(range(0, len(b))) AS i FROM p),
s AS (SELECT DISTINCT r, id, greatest(i - place, 0) AS first FROM u JOIN a ON x = anchor),
v AS (SELECT r, licence, len(sequence) AS n, first, b[first + 1:first + len(sequence)] AS win, bigrams FROM s JOIN t USING (id) JOIN p USING (r)),
m AS (SELECT r, licence, n, first, first + len(win) + 1 AS last, 2.0::DOUBLE * len(list_intersect(list_distinct(win), bigrams)) / (len(list_distinct(win)) + len(bigrams)) AS dice FROM v),
o AS (SELECT r, list([{{'licence': licence, 'first': first, 'last': last, 'dice': dice}}] ORDER BY dice DESC, n DESC, licence, first) AS ms FROM m WHERE dice >= {THRESHOLD} GROUP BY r),
k AS (SELECT r, list_reduce(ms, lambda kept, x: CASE WHEN len(list_filter(kept, lambda y: y.first < x[1].last AND x[1].first < y.last)) > 0 THEN kept ELSE list_concat(kept, x) END) AS ms FROM o)
SELECT doc_id, CAST(coalesce(len(ms), 0) AS BIGINT) AS n_notices, coalesce(array_to_string(list_sort(list_distinct(list_transform(ms, lambda x: x.licence))), ','), '') AS licences,
       round(list_max(list_transform(ms, lambda x: x.dice)), 6) AS best_dice
FROM d LEFT JOIN k USING (r)
"""


SQL = _sql()
