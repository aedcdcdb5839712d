"""Mixing sources to target weights by Sainte-Lague apportionment.

Seats (blocks of one word) go to sources by highest quotients ``target / (2 seats + 1)``, then
to the groups of a source's shards, then to the shards of a group in the same way, so
every shard has an integer quota and no window sees more than ``FAN`` of them. A shard lays
its documents out in seeded order as a line of words, cut into blocks of ``block_words``;
it takes whole passes first, and for the rest the blocks from a seeded one onwards (from
the line's end to its start), the last one only as far as the quota goes. So every
source takes its target to the word, however small it is, and a pass cuts at most two
documents of a shard. Only DataFrame functions are used.

Defined results (:func:`mix`, :func:`sample_mix`)
    * null or blank text: size 0, taken 0; the row is kept.
    * null source: a source of its own, last in the order of weights.
    * repeated rows: each is a row of its own and is laid out separately. Null ids are spread by size.
    * a very long text is one document of its shard, which is longer by as much.
    * empty table: empty result. Extra columns are ignored or (:func:`sample_mix`) kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clusterloom.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Shards in a group; a source of n shards has n / FAN groups.
FAN = 4096


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(*parts: Column) -> Column:
    """A 60-bit hash that any SQL engine with md5 can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def water_fill(stats: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``stats(source, source_size)`` plus ``target``.

    Sources in code-point order (null last) weigh ``weights`` in turn and share
    ``share`` times all words. A target stops at ``cap`` times the source's size;
    what is above is shared again by weight among the others.

    One pass suffices: in ascending order of cap / weight the capped sources come
    first, so the water level after k capped ones needs only running sums.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy(F.lit(0))
    fill = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    out = (
        stats.withColumn("weight", pick)
        .withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("_total", F.sum(F.col("source_size")).over(all_rows) * F.lit(float(share)))
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_level", level)
    )
    # Among sources that are not capped the first has the largest level; it is the water level.
    water = F.max(F.when(F.col("_ratio") > F.col("_level"), F.col("_level"))).over(all_rows)
    return out.withColumn("_water", water).select("source", "source_size", "weight", F.least(F.col("_cap"), F.coalesce(F.col("_water") * F.col("weight"), F.col("_cap"))).alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], tie: list[str], weight: str, seats: str, out: str = "quota") -> DataFrame:
    """Seats for every party, by highest quotients within each group.

    ``seats`` is the number to give in the group (the same in all its rows). With n
    parties and total weight T the winning divisor lies between T/(seats + n/2) and
    T/(seats - n/2), so each party surely has the seats of the larger divisor and at
    most those of the smaller; only the quotients in between, about 2n a group, are
    ranked. That keeps the method exact without listing every seat.
    """
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    n, total = F.count(F.lit(1)).over(whole), F.sum(F.col(weight)).over(whole)
    at = lambda sign: F.when(total > 0, F.greatest(F.lit(0.0), F.floor(F.col(weight) * (F.col(seats) + sign * n / 2) / total + 0.5))).otherwise(F.lit(0.0)).cast("long")
    base = parties.withColumn("_lo", at(-1)).withColumn("_hi", at(1)).withColumn("_rest", F.col(seats) - F.sum("_lo").over(whole))
    quotient = F.col(weight) / (2 * F.col("_seat") + 1)
    next_best = Window.partitionBy(*(group or [F.lit(0)])).orderBy(F.desc("_q"), *[F.col(c).asc_nulls_last() for c in tie], "_seat")
    won = (
        base.select(*group, *[c for c in tie if c not in group], weight, "_lo", "_rest", F.explode(F.sequence(F.col("_lo"), F.col("_hi"))).alias("_seat"))
        .withColumn("_q", quotient)
        .withColumn("_rank", F.row_number().over(next_best))
        .groupBy(*dict.fromkeys([*group, *tie]))
        .agg(F.sum(F.when((F.col("_rank") <= F.col("_rest")) & (F.col("_q") > 0), 1).otherwise(0)).alias("_won"))
    )
    keys = list(dict.fromkeys([*group, *tie]))
    a, b = base.alias("a"), won.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return a.join(b, on).select("a.*", (F.col("a._lo") + F.col("b._won")).alias(out)).drop("_lo", "_hi", "_rest")


def allocate(sized: DataFrame, *, weights=(5, 2, 1), share=1.5, cap=2.0, block_words=32, shard_words=100_000, seed=17, tie=()) -> DataFrame:
    """``sized(doc_id, source, size, ...)`` with ``source_size, target, passes, pieces``: whole copies, and word ranges (ends exclusive), that the mix takes of each row.

    ``sized`` must be a stored table. Columns in ``tie`` order rows of equal id and size.
    A shard holds about ``shard_words`` words, so a source with a third of all rows
    is spread over many shards.
    """
    stats = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    shares = water_fill(stats, weights, share, cap)
    seats = F.round(F.sum("target").over(Window.partitionBy(F.lit(0)))).cast("long")
    per_source = sainte_lague(shares.withColumn("_seats", seats), [], ["source"], "target", "_seats", "source_quota")
    per_source = per_source.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    per_source = cut(
        per_source.select("sid", F.col("source").alias("_name"), "source_size", "target", "source_quota", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long").alias("n_shards")),
        "mix-sources",
    )
    rows = sized.join(per_source, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = rows.withColumn("_h", hash60(F.lit(str(seed)), key, F.col("size").cast("string"))).withColumn("_shard", F.pmod(F.col("_h"), F.col("n_shards")))

    full = rows.where("size > 0")
    shards = full.groupBy("sid", "_shard").agg(F.sum("size").alias("n"), F.first("source_quota").alias("source_quota")).withColumn("_group", F.expr(f"_shard div {FAN}"))
    groups = shards.groupBy("sid", "_group").agg(F.sum("n").alias("m"), F.first("source_quota").alias("source_quota"))
    groups = sainte_lague(groups, ["sid"], ["_group"], "m", "source_quota", "group_quota").select("sid", "_group", "group_quota")
    quotas = sainte_lague(shards.join(groups, ["sid", "_group"]), ["sid", "_group"], ["_shard"], "n", "group_quota")
    first = F.pmod(hash60(F.lit(str(seed)), F.col("sid").cast("string"), F.col("_shard").cast("string")), F.ceil(F.col("n") / block_words).cast("long")) * block_words
    quotas = quotas.select("sid", "_shard", "n", F.least(F.col("quota"), (F.lit(float(cap)) * F.col("n")).cast("long")).alias("quota"), first.alias("first"))

    line = Window.partitionBy("sid", "_shard").orderBy("_h", "doc_id", "size", *tie).rowsBetween(Window.unboundedPreceding, 0)
    laid = full.withColumn("_off", F.sum("size").over(line) - F.col("size")).join(quotas, ["sid", "_shard"])
    # The blocks after the passes: from ``first`` on, and from 0 on what goes over the end.
    end = F.col("first") + F.expr("quota % n")
    within = lambda lo, hi: F.struct(F.greatest(lo, F.col("_off")).alias("start"), F.least(hi, F.col("_off") + F.col("size")).alias("end"))
    both = F.array(within(F.lit(0).cast("long"), end - F.col("n")), within(F.col("first"), F.least(end, F.col("n"))))
    pieces = F.transform(F.filter(both, lambda p: p["end"] > p["start"]), lambda p: F.struct((p["start"] - F.col("_off")).alias("start"), (p["end"] - F.col("_off")).alias("end")))
    names = [*sized.columns, "source_size", "target", "passes", "pieces"]
    laid = laid.withColumn("passes", F.expr("quota div n")).withColumn("pieces", pieces)
    blank = rows.where("size = 0").withColumn("passes", F.lit(0).cast("long")).withColumn("pieces", F.array().cast("array<struct<start:bigint,end:bigint>>"))
    return laid.select(*names).unionByName(blank.select(*names))


def mix(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", **settings) -> DataFrame:
    """``doc_id, size, source_size, target, taken``: the words the mix takes of each row. For ``settings`` see :func:`allocate`."""
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size")), "mix-sizes")
    parts = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["end"] - p["start"])
    return allocate(sized, **settings).select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + parts).alias("taken"))


def op9_mixing(spark, sf_dir):
    """The mix of all documents."""
    from clusterloom.llm.common import table

    return mix(table(spark, sf_dir, "documents"))


def sample_mix(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix as rows, columns as in ``docs``: a row for each whole copy, and one for each range of words.

    Every source has exactly the words that :func:`mix` takes of it. A range's words are joined by
    single spaces, and ``n_chars`` (if there) follows; whole copies are not changed. A blank document stays once.
    """
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]  # no column of the input has a name of this function
    of = lambda name: F.col(plain[names.index(name)])
    counted = docs.toDF(*plain).withColumns({"row": F.monotonically_increasing_id(), "size": words(of("text")), "h": F.xxhash64(of("text"))})
    rows = cut(counted, "mix-rows")  # once stored, a row keeps its number
    sized = rows.select("row", of("doc_id").alias("doc_id"), of("source").alias("source"), "size", "h")
    rows = rows.drop("size", "h")
    whole = F.struct(F.lit(0).cast("long").alias("start"), F.col("size").alias("end"))
    copies = F.concat(F.array_repeat(whole, F.when(F.col("size") == 0, 1).otherwise(F.col("passes")).cast("int")), F.col("pieces"))
    taken = allocate(sized, tie=("h", "row"), **settings).select("row", "size", F.explode(copies).alias("p"))
    out = rows.join(taken, "row")
    part = F.array_join(F.slice(F.regexp_extract_all(of("text"), F.lit(WORD), F.lit(0)), (F.col("p.start") + 1).cast("int"), (F.col("p.end") - F.col("p.start")).cast("int")), " ")
    is_part = F.col("p.end") - F.col("p.start") < F.col("size")
    out = out.withColumn("part", F.when(is_part, part))
    new = {"text": F.when(is_part, F.col("part")).otherwise(of("text"))}
    if "n_chars" in names:
        new["n_chars"] = F.when(is_part, F.length("part")).otherwise(of("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(n, F.col(c)).alias(n) for n, c in zip(names, plain, strict=True)])


def _quotas_sql(out: str, parties: str, group: str, tie: str) -> str:
    """Sainte-Lague in SQL: ``parties`` has w (weight) and q (seats of the group); ``group`` is a list of columns with a comma after each, or empty."""
    over = f"PARTITION BY {group.rstrip(', ')}" if group else ""
    return f"""
{out}_b AS (SELECT *, count(*) OVER ({over}) AS cnt, sum(w) OVER ({over})::DOUBLE AS total FROM {parties}),
{out}_l AS (SELECT *, CAST(greatest(0.0, floor(w * (q - cnt / 2.0::DOUBLE) / total + 0.5)) AS BIGINT) AS lo, CAST(greatest(0.0, floor(w * (q + cnt / 2.0::DOUBLE) / total + 0.5)) AS BIGINT) AS hi FROM {out}_b),
{out}_s AS (SELECT {group}{tie}, unnest(range(lo, hi + 1)) AS seat, w, rest FROM (SELECT *, q - sum(lo) OVER ({over}) AS rest FROM {out}_l)),
{out}_r AS (SELECT {group}{tie}, rest, row_number() OVER ({over} ORDER BY w / (2 * seat + 1) DESC, {tie} ASC NULLS LAST, seat) AS rk FROM {out}_s),
{out}_w AS (SELECT {group}{tie}, count(*) FILTER (WHERE rk <= rest) AS won FROM {out}_r GROUP BY ALL),
{out} AS (SELECT a.*, a.lo + b.won AS quota FROM {out}_l a JOIN {out}_w b ON {' AND '.join(f'a.{c} IS NOT DISTINCT FROM b.{c}' for c in [*filter(None, group.split(', ')), tie])}),"""


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
stats AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
named AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM stats),
caps AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((sid - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap, (SELECT sum(source_size) FROM stats)::DOUBLE * 1.5::DOUBLE AS total FROM named),
levels AS (
  SELECT *, cap / weight AS ratio,
    (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
targets AS (SELECT sid, source, source_size, least(cap, coalesce((SELECT max(level) FROM levels WHERE ratio > level) * weight, cap)) AS target FROM levels),
seats AS (SELECT *, target AS w, CAST(round((SELECT sum(target) FROM targets)) AS BIGINT) AS q FROM targets),{_quotas_sql('src', 'seats', '', 'source')}
docs AS (
  SELECT z.*, s.sid, s.source_size, s.target, s.quota AS q, ('0x' || substr(md5('17|' || doc_id || '|' || size), 1, 15))::BIGINT AS h, greatest(1, CAST(ceil(s.source_size / 100000.0) AS BIGINT)) AS n_shards
  FROM sized z JOIN src s ON z.source IS NOT DISTINCT FROM s.source),
dealt AS (SELECT *, h % n_shards AS shard, (h % n_shards) // {FAN} AS grp FROM docs),
grps AS (SELECT sid, grp, sum(size)::DOUBLE AS w, any_value(q) AS q FROM dealt WHERE size > 0 GROUP BY sid, grp),{_quotas_sql('grq', 'grps', 'sid, ', 'grp')}
shards AS (SELECT d.sid, d.grp, shard, sum(size)::DOUBLE AS w, any_value(g.quota) AS q FROM dealt d JOIN grq g ON d.sid = g.sid AND d.grp = g.grp WHERE size > 0 GROUP BY ALL),{_quotas_sql('shq', 'shards', 'sid, grp, ', 'shard')}
plan AS (
  SELECT sid, shard, w::BIGINT AS n, least(quota, 2 * w::BIGINT) AS quota, 32 * (('0x' || substr(md5('17|' || sid || '|' || shard), 1, 15))::BIGINT % CAST(ceil(w / 32) AS BIGINT)) AS a FROM shq),
laid AS (SELECT *, CAST(sum(size) OVER (PARTITION BY sid, shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS o FROM dealt WHERE size > 0)
SELECT doc_id, size, source_size, target, CAST(
    quota // n * size + greatest(0, least(o + size, a + quota % n, n) - greatest(o, a)) + greatest(0, least(o + size, a + quota % n - n) - o) AS BIGINT) AS taken
FROM laid JOIN plan USING (sid, shard)
UNION ALL SELECT doc_id, size, source_size, target, CAST(0 AS BIGINT) FROM docs WHERE size = 0
"""
