"""Secret scans: strong spans by pattern, weak parts by multipart credential linking. DataFrame functions only.

A credential often comes in parts: who (an access identifier, a user name), what (a secret) and where (an
endpoint). A user name, an address or an opaque string alone is no finding; next to a complementary part it
is. Parts are interval-joined inside scopes of ``scope`` code points: each weak part counts, by range frames
over the parts of its row, the complementary parts that start inside its scope. Every step is linear in the
parts: positions are running sums over the pieces between matches, and no pair is ever emitted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept, table

#: Fixed values. Kind, role, pattern, group whose length counts, least length of it. The first three are strong.
KINDS = (
    ("assign", "secret", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "identifier", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", "secret", r"[0-9a-f]+", 0, 32),
    ("ident", "identifier", r"""((?i:username|user|login|client_?id|account_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 2, 3),
    ("endpoint", "endpoint", r"""https?://[^\x00-\x20"'<>]+""", 0, 10),
    ("opaque", "secret", r"[A-Za-z0-9+/_-]+", 0, 20),
)
STRONG = ("assign", "access", "hex")
#: Code points between the starts of two parts of one credential, at most.
SCOPE = 200
#: A text has a span of a kind only if this matches it (cheaper than finding them all).
_HINTS = {
    "assign": KINDS[0][2].removesuffix("+)") + "{8,})",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
    "ident": KINDS[3][2].removesuffix("+)") + "{3,})",
    "endpoint": KINDS[4][2],
    "opaque": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20}",
}
_PART = "array<struct<kind:string,i:int,gap:int,len:int,ok:boolean>>"


def _parts(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Matches in order: kind, number, code points since the last match's end, length, whether it counts."""
    if kind in ("access", "hex"):  # runs of a class: the same matches, without the short ones
        pattern, least = pattern.removesuffix("+") + ("{12,}" if kind == "access" else "{32,}"), 0
    if kind == "opaque":
        pattern, least = _HINTS[kind].removesuffix("{20}") + "{20,}", 0
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    size = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length) if group else F.transform(found, F.length)
    rows = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), F.transform(found, F.length), lambda g, n: F.struct(g.alias("gap"), n.alias("len")))
    rows = F.zip_with(rows, size, lambda r, n: F.struct(F.lit(kind).alias("kind"), r["gap"].alias("gap"), r["len"].alias("len"), (n >= least).alias("ok")))
    rows = F.transform(rows, lambda r, i: F.struct(r["kind"].alias("kind"), i.alias("i"), r["gap"].alias("gap"), r["len"].alias("len"), r["ok"].alias("ok")))
    return F.when(text.rlike(_HINTS[kind]), rows).otherwise(F.array().cast(_PART))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, text's parts: one row per row of ``docs`` with its base spans and its linked ones.

    ``base`` and ``linked`` are arrays of (start, kind's place, kind, end) in code points, end exclusive. A null
    or empty text has none. Spans of one kind don't overlap; of different kinds they may. A weak opaque string
    inside another span is part of that span and no part of its own. Repeated rows are scanned one by one; other
    columns don't matter; an empty table gives no rows.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    slim = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].alias("doc_id"), text.alias("text"))
    parts = F.concat(*[_parts(F.col("text"), k, p, g, n) for k, _, p, g, n in KINDS])
    rows = slim.select("row", "doc_id", F.explode_outer(parts).alias("p")).select("row", "doc_id", "p.*")
    rows = rows.repartition("row")
    run = W.partitionBy("row", "kind").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(run)).filter(F.col("ok") | F.col("ok").isNull() | (F.col("i") == 0))
    rows = rows.withColumn("ok", F.coalesce("ok", F.lit(False)))  # each row keeps at least one line
    rows = rows.withColumn("start", F.col("end") - F.col("len"))
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k[0]), F.lit(i))])
    role = F.create_map(*[x for k in KINDS for x in (F.lit(k[0]), F.lit(k[1]))])
    rows = rows.withColumn("place", order[F.col("kind")]).withColumn("role", role[F.col("kind")])
    solid = F.col("ok") & (F.col("kind") != "opaque")
    back = W.partitionBy("row").orderBy("start", "place").rowsBetween(W.unboundedPreceding, -1)
    ahead = W.partitionBy("row").orderBy(F.desc("start"), F.desc("place")).rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.max(F.when(solid, F.col("end"))).over(back) > F.col("start"), F.lit(False)) | F.coalesce(F.min(F.when(solid, F.col("start"))).over(ahead) < F.col("end"), F.lit(False))
    rows = rows.withColumn("part", F.col("ok") & ~((F.col("kind") == "opaque") & inside))
    near = W.partitionBy("row").orderBy("start").rangeBetween(-scope, scope)
    count = lambda *roles: F.count(F.when(F.col("part") & F.col("role").isin(*roles), 1)).over(near)
    weak = F.col("part") & ~F.col("kind").isin(*STRONG)
    linked = weak & F.when(F.col("role") == "secret", count("identifier", "endpoint") > 0).otherwise(count("secret") > 0)
    span = F.struct("start", "place", "kind", "end")
    rows = rows.withColumn("linked", linked)
    strong = F.col("ok") & F.col("kind").isin(*STRONG)
    return rows.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        *[F.count(F.when(F.col("ok") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in STRONG],
        F.collect_list(F.when(strong, span)).alias("base"),
        F.collect_list(F.when(F.col("linked"), span)).alias("linked"),
    )


def redacted(docs: DataFrame, scope: int = SCOPE, mark: str = "[redacted]") -> DataFrame:
    """The rows of ``docs``, with their columns; in ``text`` each span, or run of overlapping spans, is the mark.

    ``n_chars``, if there is one, is the new text's length where the text changed. Spans hang on the text alone, so they
    are found by it: rows with equal texts share them.
    """
    found = scan(docs.select(F.md5("text").alias("doc_id"), docs["text"].alias("text")), scope)
    spans = found.select(F.col("doc_id").alias("__hash"), F.array_sort(F.concat("base", "linked")).alias("__spans")).filter(F.size("__spans") > 0)
    spans = kept(spans.groupBy("__hash").agg(F.max("__spans").alias("__spans")))
    own = docs.select(F.struct("*").alias("row"), docs["text"].alias("text"), F.md5(docs["text"]).alias("__own")).join(spans, F.col("__own") == F.col("__hash"), "left")

    def cut(state: Column, s: Column) -> Column:
        gap = F.greatest(F.lit(0), (s["start"] - state["at"]).cast("int"))
        piece = F.col("text").substr((state["at"] + 1).cast("int"), gap)
        out = F.concat(state["out"], piece, F.when((s["start"] >= state["at"]) & (s["end"] > state["at"]), mark).otherwise(""))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    rest = lambda state: F.concat(state["out"], F.col("text").substr((state["at"] + 1).cast("int"), F.length("text")))
    clean = F.aggregate("__spans", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), cut, rest)
    changed = F.col("__spans").isNotNull()
    own = own.select("row", F.when(changed, clean).otherwise(F.col("text")).alias("text"), changed.alias("changed"))
    kinds = dict(docs.dtypes)
    new = {"text": F.col("text"), "n_chars": F.when(F.col("changed"), F.length("text").cast(kinds.get("n_chars", "long"))).otherwise(F.col("row")["n_chars"])}
    return own.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "linked")).alias("spans"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    return digests(scan(table(spark, sf_dir, "documents")))


def _sql() -> str:
    """Each pattern runs once over a text; its matches and the pieces between them are unnested side by side."""
    lit = lambda p: p.replace("'", "''")
    out = []
    for i, (k, role, p, g, n) in enumerate(KINDS):
        ok = f"length(v) >= {n}" + (" AND regexp_matches(f, '[0-9]') AND regexp_matches(f, '[a-z]') AND regexp_matches(f, '[A-Z]')" if k == "opaque" else "")
        out.append(
            f"SELECT doc_id, '{k}' AS kind, {i} AS place, '{role}' AS role, j, length(s) AS gap, length(f) AS len, {ok} AS ok "
            f"FROM (SELECT doc_id, unnest(range(1, len(f) + 1)) AS j, unnest(f) AS f, unnest(v) AS v, unnest(s[1:len(f)]) AS s "
            f"FROM (SELECT doc_id, regexp_extract_all(t, '{lit(p)}', 0) AS f, regexp_extract_all(t, '{lit(p)}', {g}) AS v, regexp_split_to_array(t, '{lit(p)}') AS s FROM d))"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(out)}),
e AS (SELECT *, sum(gap + len) OVER (PARTITION BY doc_id, kind ORDER BY j) AS fin FROM m),
s AS (SELECT doc_id, kind, place, role, (fin - len)::BIGINT AS beg, fin::BIGINT AS fin FROM e WHERE ok),
p AS (SELECT * FROM s WHERE kind <> 'opaque' OR NOT EXISTS (
        SELECT 1 FROM s AS o WHERE o.doc_id = s.doc_id AND o.kind <> 'opaque' AND o.beg < s.fin AND o.fin > s.beg)),
l AS (SELECT *, place < 3 OR EXISTS (SELECT 1 FROM p AS o WHERE o.doc_id = p.doc_id AND abs(o.beg - p.beg) <= {SCOPE}
        AND CASE WHEN p.role = 'secret' THEN o.role <> 'secret' ELSE o.role = 'secret' END) AS told FROM p),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || beg || ':' || fin, ',' ORDER BY beg, place) FILTER (place < 3) AS base,
        string_agg(kind || ':' || beg || ':' || fin, ',' ORDER BY beg, place) FILTER (told) AS spans FROM l GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""


OP10_SQL = _sql()
