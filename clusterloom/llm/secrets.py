"""Secret scanning with an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its content. The ledger
holds one row per (blob, rule version) that has been scanned, with its findings, so
a blob is read again only for a rule version it has not met, however many paths and
versions share it. Findings are joined back to all paths. DataFrame functions only.

Beside the base rules there are rules for private keys, signed tokens and forge tokens;
their spans are added to those of the base rules.

Defined results
    * null text is the empty text: scanned, no finding.
    * repeated rows and copies share one scan; every row is in the result. Several texts under one id are versions of it.
    * null ids are kept. Empty table: empty result. Extra columns are ignored, or kept by :func:`redact`, whatever their names.
    * positions are in code points, ends exclusive; long texts are scanned whole.
    * spans of one start go in the order of the rules; equal texts have equal findings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clusterloom.llm.common import cut, scratch_path, table

LEDGER = "blob string, rule string, kind string, spans array<struct<start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    """A pattern, matched leftmost and without overlaps; a match counts if its ``group`` has ``least`` code points."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


# The patterns that the contract names.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24),
)


#: Well-known forms of further secrets.
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
)
ALL_RULES = RULES + MORE


def _quick(rule: Rule) -> str:
    """A necessary condition that a scan can test quickly; the whole pattern decides afterwards."""
    return {"hex": r"[0-9a-f]{24}", "access": r"AKIA[A-Z0-9]{16}"}.get(rule.kind, rule.pattern) if rule in RULES else rule.pattern


def address(text: Column) -> Column:
    """Content address of a version."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def addresses(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """``path, h, blob``: every row's id, a short hash of its text to find it again, and its content address."""
    return docs.select(F.col(id_col).alias("path"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), address(F.col(text_col)).alias("blob"))


def unseen(at: DataFrame, ledger: DataFrame | None, rules=RULES) -> DataFrame:
    """``blob, path, h, todo``: blobs that the ledger lacks for some rule version, with these, and one row to read each from.

    The row (smallest id) is chosen on addresses only, with map-side aggregation, so a blob on a third of all paths costs one row per task.
    """
    every = F.array(*[F.lit(r.id) for r in rules])
    reps = at.groupBy("blob").agg(F.min(F.struct("path", "h")).alias("first")).select("blob", "first.path", "first.h")
    if ledger is None:
        return reps.withColumn("todo", every)
    seen = ledger.where(F.col("rule").isin([r.id for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    left = F.array_except(every, F.coalesce(F.col("seen"), F.array().cast("array<string>")))
    return reps.join(seen, "blob", "left").withColumn("todo", left).where(F.size("todo") > 0).drop("seen")


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES, *, id_col="doc_id", text_col="text", at: DataFrame | None = None) -> DataFrame:
    """New ledger rows: each (blob, rule version) of ``docs`` that ``ledger`` lacks, with its findings. ``at``: the stored addresses of ``docs``, if known."""
    at = addresses(docs, id_col=id_col, text_col=text_col) if at is None else at
    todo = unseen(at, ledger, rules)
    if ledger is not None:
        todo = cut(todo, "secret-todo")
        if todo.isEmpty():  # no text is read
            return docs.sparkSession.createDataFrame([], LEDGER)
    text = F.coalesce(F.col(text_col), F.lit(""))
    a, b = docs.select(F.col(id_col).alias("path"), text.alias("text")).withColumn("h", F.xxhash64("text")).alias("a"), todo.alias("b")
    fresh = a.join(b, F.col("a.path").eqNullSafe(F.col("b.path")) & (F.col("a.h") == F.col("b.h"))).select("b.blob", "a.text", "b.todo")
    t = F.col("text")
    size_of = lambda arr: F.transform(arr, lambda x: F.length(x).cast("long"))
    kinds = [
        F.when(
            F.array_contains("todo", r.id) & t.rlike(_quick(r)),
            F.struct(
                F.lit(r.id).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(r.least).alias("least"),
                size_of(F.split(t, r.pattern, -1)).alias("gaps"),
                size_of(F.regexp_extract_all(t, F.lit(r.pattern), F.lit(0))).alias("lens"),
                size_of(F.regexp_extract_all(t, F.lit(r.pattern), F.lit(r.group))).alias("vals"),
            ),
        )
        for r in rules
    ]
    hits = fresh.select("blob", F.explode(F.array(*kinds)).alias("m")).where("m is not null")
    # All matches lie between the pieces of split(); running sums of both lengths give the starts.
    one = hits.select("blob", "m.rule", "m.kind", "m.least", F.posexplode(F.arrays_zip("m.gaps", "m.lens", "m.vals")).alias("i", "x")).where("x.lens is not null")
    upto = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.expr("x.gaps + x.lens")).over(upto)
    spans = (
        one.dropDuplicates(["blob", "rule", "i"])
        .select("blob", "rule", "kind", "least", "x.vals", (end - F.col("x.lens")).alias("start"), end.alias("end"))
        .where("vals >= least")
        .groupBy("blob", "rule")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    )
    pairs = todo.select("blob", F.explode("todo").alias("rule")).withColumn("kind", F.element_at(F.split("rule", "@"), 1))
    return pairs.join(spans, ["blob", "rule"], "left").select("blob", "rule", "kind", F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"))


def update_ledger(docs: DataFrame, path: str, rules=RULES, **cols) -> DataFrame:
    """Scan what the ledger table at ``path`` has not seen, append it there, return the whole ledger."""
    spark = docs.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    old = spark.read.schema(LEDGER).parquet(path) if there else None
    scan_unseen(docs, old, rules, **cols).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def findings(ledger: DataFrame, rules=RULES) -> DataFrame:
    """``blob, findings`` of the blobs that have any; findings are ordered by start, then by rule order."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    spans = ledger.where(F.col("rule").isin([r.id for r in rules]) & (F.size("spans") > 0)).select("blob", "kind", F.explode("spans").alias("s"))
    one = F.struct(F.col("s.start").alias("start"), order[F.col("kind")].alias("rank"), F.col("s.end").alias("end"), "kind")
    return spans.groupBy("blob").agg(F.sort_array(F.collect_list(one)).alias("findings"))


def attach(docs: DataFrame, ledger: DataFrame, rules=RULES, *, id_col="doc_id", text_col="text", at: DataFrame | None = None) -> DataFrame:
    """Every row of ``docs`` as ``path, blob, findings``.

    Findings of a blob are put together before the join, so the join needs each path
    once and a blob with very many paths can be split by skew handling.
    """
    at = addresses(docs, id_col=id_col, text_col=text_col) if at is None else at
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    return at.join(findings(ledger, rules), "blob", "left").select("path", "blob", F.coalesce("findings", empty).alias("findings"))


def find_secrets(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES, **cols) -> DataFrame:
    """Scan unseen pairs, add them to ``ledger``, join all findings back to all paths."""
    at = cut(addresses(docs, **cols), "secret-addresses")
    new = cut(scan_unseen(docs, ledger, rules, at=at, **cols), "secret-ledger")
    return attach(docs, new if ledger is None else ledger.unionByName(new), rules, at=at)


def redact(docs: DataFrame, ledger: str | None = None, rules=ALL_RULES) -> DataFrame:
    """``docs`` with every finding replaced by ``[secret]``; overlapping findings become one.

    Texts without a finding stay as they are. Columns and row count do not change,
    except that ``n_chars`` (if there) follows the new text. ``ledger``: path of the ledger table (None: a new one).
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # no column of the input has a name of this function
    of = lambda name: f"c{names.index(name)}"
    known = update_ledger(plain, ledger or scratch_path(docs.sparkSession, "secret-ledger"), rules, id_col=of("doc_id"), text_col=of("text"))
    rows = plain.withColumn("text", F.col(of("text"))).withColumn("blob", address(F.col("text"))).join(findings(known, rules), "blob", "left")
    clean = F.expr(
        "aggregate(findings, named_struct('out', '', 'at', 0L),"
        " (acc, f) -> IF(f.end <= acc.at, acc, named_struct("
        "   'out', IF(f.start >= acc.at, concat(acc.out, substring(text, cast(acc.at + 1 as int), cast(f.start - acc.at as int)), '[secret]'), acc.out), 'at', f.end)),"
        " acc -> concat(acc.out, substring(text, cast(acc.at + 1 as int))))"
    )
    hit = F.col("findings").isNotNull()
    rows = rows.withColumn("clean", F.when(hit, clean).otherwise(F.col("text")))
    new = {"text": F.col("clean")}
    if "n_chars" in names:
        new["n_chars"] = F.when(hit, F.length("clean")).otherwise(F.col(of("n_chars"))).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(n, F.col(f"c{i}")).alias(n) for i, n in enumerate(names)])


def deliver(docs: DataFrame, path: str, rules=ALL_RULES, *, deliveries: int = 2, id_col="doc_id", text_col="text") -> DataFrame:
    """``path, blob, findings`` of every row, after ``docs`` went into the ledger table at ``path`` in several deliveries.

    A path's delivery follows from its hash; each one scans only the blobs that no former one held.
    """
    at = cut(addresses(docs, id_col=id_col, text_col=text_col), "secret-addresses")
    turn = lambda c: F.pmod(F.xxhash64(c), F.lit(deliveries))
    for k in range(deliveries):
        update_ledger(docs.where(turn(id_col) == k), path, rules, id_col=id_col, text_col=text_col, at=at.where(turn("path") == k))
    return attach(docs, docs.sparkSession.read.schema(LEDGER).parquet(path), rules, at=at)


def op4_secrets(spark, sf_dir):
    """Counts and digests of all findings in all documents, delivered to a ledger in the shared folder."""
    found = deliver(table(spark, sf_dir, "documents"), scratch_path(spark, "secret-ledger"))
    n = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = spans(F.filter("findings", lambda x: x["rank"] < len(RULES)))
    return found.select(F.col("path").alias("doc_id"), *[n(r.kind) for r in RULES], F.sha2(base.cast("binary"), 256).alias("base_sha256"), spans("findings").alias("spans"), *[n(r.kind) for r in MORE])


def _matches(order: int, rule: Rule) -> str:
    p = f"$p${rule.pattern}$p$"
    return f"SELECT r, '{rule.kind}' AS kind, {order} AS o, {rule.least} AS least, string_split_regex(x, {p}) AS g, regexp_extract_all(x, {p}) AS h, regexp_extract_all(x, {p}, {rule.group}) AS v FROM t"


_COUNTS = [r.kind for r in ALL_RULES]
ORACLE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, row_number() OVER () AS r FROM documents),
m AS ({' UNION ALL '.join(_matches(i, r) for i, r in enumerate(ALL_RULES))}),
e AS (SELECT r, kind, o, least, unnest(range(1, len(h) + 1)) AS i, g, h, v FROM m),
s AS (SELECT r, kind, o, least, i, length(v[i]) AS vl, length(h[i]) AS hl, sum(length(g[i]) + length(h[i])) OVER (PARTITION BY r, kind ORDER BY i ROWS UNBOUNDED PRECEDING) AS en FROM e),
f AS (SELECT r, kind, o, CAST(en - hl AS BIGINT) AS st, CAST(en AS BIGINT) AS en FROM s WHERE vl >= least),
a AS (
  SELECT r, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in _COUNTS)},
    string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, o) FILTER (WHERE o < {len(RULES)}) AS base, string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, o) AS spans FROM f GROUP BY r)
SELECT t.doc_id, {', '.join(f"coalesce(a.n_{k}, 0)::BIGINT AS n_{k}" for k in _COUNTS)},
  sha256(coalesce(a.base, '')) AS base_sha256, coalesce(a.spans, '') AS spans
FROM t LEFT JOIN a ON t.r = a.r
"""
