"""Mixing sources to target weights by balanced sampling with the cube method.

Targets share all words by the sources' weights; a target above `most` times its source's words is cut to that and
the excess shared again. A document of a source is due target/words copies: the whole part is certain, the fractional part is an
inclusion probability. The flight phase moves the probabilities of three documents at a time along the vector that changes neither
the number of documents nor the number of words, until one of them is 0 or 1, so both totals of a source stay exact. Before that, the few documents
that are far larger than the others fly, each against all others of its block, along a vector that keeps the words alone.

Documents fly in blocks of bounded size, by hash within a source, so a hot source is many blocks; equal rows are numbered for that, by counts, so they
are dealt to all blocks too. In a block, large documents fly first, so that those left at its end are small. A block leaves two
documents at most; those of a source meet in blocks again, level by level, until one block of a source
is left. Only then the landing phase rounds the last two, by which choice is nearest to the balance. Nothing but numbers
is shuffled: no texts. Random choices come from a hash of seed, source, level and block, so reruns agree.

Null texts have size 0; null sources are a source of their own, last in order; equal rows are units of their own, and which of them is taken makes no difference. Sources without words have target 0.
An empty table gives an empty table. doc_id and text are read for a row's hash, other columns only in `mix_documents`.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazgrid.llm import common as C

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    #: Repeating over the sources in order of code points.
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    most: float = 3.0
    block: int = 512
    #: Documents of so many times a block's mean fly first, by words alone.
    large: float = 4.0
    seed: int = 17


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(docs: DataFrame) -> Column:
    """Equal for rows with equal doc_id and text only (but for collisions of two 64-bit hashes within one doc_id)."""
    return F.xxhash64(F.coalesce(docs["doc_id"].cast("string"), F.lit("null")), docs["text"])


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].alias("source"), size_of(docs["text"]).alias("size"), row_key(docs).alias("k"))


def targets(units: DataFrame, mix: Mix) -> DataFrame:
    """source, its documents and words, and its target: a row for each source.

    Sources fill up in order of words a weight. One is cut if what all would get a weight,
    once those before it are cut, reaches its bound; so the cut ones are the first of that order.
    """
    w = F.element_at(F.array(*map(F.lit, mix.weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(mix.weights) + 1).cast("int"))
    by = units.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")).withColumn("w", w).withColumn("cap", mix.most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    by = by.withColumns({
        "left": F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "w_left": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
    }).withColumn("cut", F.col("cap") * F.col("w_left") <= F.col("w") * F.col("left"))
    cut = lambda c: F.coalesce(F.sum(F.when(F.col("cut"), F.col(c))).over(every), F.lit(0.0))
    by = by.withColumns({"rest": F.sum("source_size").over(every) - cut("cap"), "w_rest": F.sum("w").over(every) - cut("w")})
    target = F.when(F.col("cut"), F.col("cap")).otherwise(F.col("w") * F.col("rest") / F.expr("nullif(w_rest, 0)"))
    return by.select("source", "n", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def moved(size: list[int], p: list[float], held: list[int], move: tuple[int, ...], rng: random.Random) -> list[int]:
    """Moves the held places of p along the vector or against it, as far as they go, by chances that keep each expectation; returns those still between 0 and 1."""
    up = down = float("inf")
    for j, m in zip(held, move, strict=True):
        if m > 0:
            up, down = min(up, (1 - p[j]) / m), min(down, p[j] / m)
        elif m < 0:
            up, down = min(up, p[j] / -m), min(down, (1 - p[j]) / -m)
    step = up if rng.random() * (up + down) < down else -down
    for j, m in zip(held, move, strict=True):
        p[j] += step * m
        if p[j] < 1e-9:
            p[j] = 0.0
        elif p[j] > 1 - 1e-9:
            p[j] = 1.0
    return [j for j in held if 0.0 < p[j] < 1.0]


def flight(size: list[int], p: list[float], rng: random.Random, large: float = float("inf")) -> list[int]:
    """Moves p (in place) to 0 and 1 with sum(p * size) kept, and sum(p) too once none above `large` is left; returns the two places at most that stay between.

    A document far above the others hardly moves beside two of them along the vector that keeps both totals, and would be left for the landing. It
    flies first, against all smaller ones at once. The others go in the order given.
    """
    for i in [i for i in range(len(p)) if size[i] > large]:
        while 0.0 < p[i] < 1.0 and (rest := [j for j in range(len(p)) if 0 < size[j] <= large and 0.0 < p[j] < 1.0]):
            moved(size, p, [i, *rest], (sum(size[j] for j in rest), *[-size[i]] * len(rest)), rng)
    held: list[int] = []
    for i in [i for i in range(len(p)) if 0.0 < p[i] < 1.0]:
        held.append(i)
        while len(held) == 3:
            a, b, c = held
            move = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
            if not any(move):  # equal sizes: any change of two that keeps their sum
                move = (1, -1, 0)
            held = moved(size, p, held, move, rng)
    return held


def landing(size: list[int], p: list[float], held: list[int], rng: random.Random) -> None:
    """Rounds what is left: by the choice nearest to the words due, then to the documents due, then at random."""
    best = None
    for choice in range(1 << len(held)):
        bits = [choice >> j & 1 for j in range(len(held))]
        off = (abs(sum((b - p[i]) * size[i] for b, i in zip(bits, held, strict=True))), abs(sum(b - p[i] for b, i in zip(bits, held, strict=True))), rng.random())
        if best is None or off < best[0]:
            best = off, bits
    for b, i in zip(best[1], held, strict=True):
        p[i] = float(b)


def numbered(rows: DataFrame, many: str, number: str, step: int = 4096) -> DataFrame:
    """As many rows as the column many says, numbered from 1; in two steps, so that no array is long."""
    steps = rows.withColumn("_from", F.explode(F.sequence(F.lit(1), F.col(many), F.lit(step))))
    return steps.withColumn(number, F.explode(F.sequence("_from", F.least(F.col("_from") + (step - 1), F.col(many))))).drop("_from")


def fly(units: DataFrame, mix: Mix, level: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("k", "ascending"), ("doc_id", "ascending"), ("j", "ascending")])
        size, p = table["size"].to_pylist(), table["p"].to_pylist()
        rng = random.Random(f"{mix.seed}/{table['source'][0].as_py()}/{level}/{table['block'][0].as_py()}")
        held = flight(size, p, rng, mix.large * sum(size) / len(size))
        if table["last"][0].as_py():
            landing(size, p, held, rng)
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))

    return units.groupBy("source", "block").applyInArrow(run, units.schema)


def sample(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row a document: doc_id, source, k (its row's hash), size, source_size, target and copies."""
    units = C.written(numbered(sized(docs).groupBy("doc_id", "source", "size", "k").agg(F.count("*").alias("m")), "m", "j").drop("m"), "units")
    plan = targets(units, mix)
    u = units.alias("u").join(plan.alias("t"), F.col("u.source").eqNullSafe(F.col("t.source"))).select("u.source", "u.doc_id", "u.k", "u.j", "u.size", "t.source_size", "t.target", (F.col("t.target") / F.expr("nullif(t.source_size, 0)")).alias("due"), "t.n")
    u = u.withColumn("due", F.coalesce("due", F.lit(0.0))).withColumn("p", F.col("due") - F.floor("due"))
    u = u.withColumn("due", F.when(F.col("p") > 1 - 1e-9, F.ceil("due")).otherwise(F.floor("due")).cast("double")).withColumn("p", F.when(F.col("p").between(1e-9, 1 - 1e-9), F.col("p")).otherwise(0.0))
    columns = ["source", "doc_id", "k", "j", "size", "source_size", "target", "due", "p"]

    def blocked(df: DataFrame, n: Column, level: int) -> DataFrame:
        count = F.greatest(F.ceil(n / mix.block), F.lit(1)).cast("long")
        return df.withColumn("n_blocks", count).withColumn("block", F.pmod(F.xxhash64(F.lit(mix.seed + level), "k", "j"), F.col("n_blocks"))).withColumn("last", F.col("n_blocks") == 1)

    done = [u.where("p = 0.0").select(*columns)]
    now, level = blocked(u.where("p > 0.0"), F.col("n"), 0).select(*columns, "n_blocks", "block", "last"), 0
    most = plan.agg(F.max("n")).first()[0] or 0  # one number
    while True:
        flown = C.written(fly(now, mix, level), "flown")
        done.append(flown.where("p in (0.0, 1.0)").select(*columns))
        if most <= mix.block:
            break
        # A block leaves two units at most.
        most, level = 2 * -(-most // mix.block), level + 1
        now = blocked(flown.where("p > 0.0 and p < 1.0").select(*columns, (2 * F.col("n_blocks")).alias("n")), F.col("n"), level).select(*columns, "n_blocks", "block", "last")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "source", "k", "size", "source_size", "target", (F.col("due") + F.col("p")).cast("long").alias("copies"))


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The documents, each as often as it was sampled, with their own columns.

    Rows equal in doc_id and text share their copies: they are counted by all columns, and take them in order of a hash of those, so that a task that runs again gives the same.
    """
    picks = C.written(sample(docs, mix).groupBy(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("k").alias("_k")).agg(F.sum("copies").alias("_c"), F.count("*").alias("_m")).where("_c > 0"), "picks")
    own = docs.columns
    held = docs.select(F.struct(*[docs[c] for c in own]).alias("_row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(0)).alias("_id"), row_key(docs).alias("_k")).join(picks, ["_id", "_k"])
    equal = held.where("_m > 1").groupBy("_id", "_k", "_c", "_m", "_row").agg(F.count("*").alias("_r"))
    before = F.coalesce(F.sum("_r").over(Window.partitionBy("_id", "_k").orderBy(F.xxhash64(F.to_json("_row")), "_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shared = F.expr("_r * (_c div _m)") + F.least(F.col("_r"), F.greatest(F.lit(0), F.expr("_c % _m") - before))
    taken = held.where("_m = 1").select("_row", F.col("_c").alias("_n")).unionByName(equal.select("_row", shared.alias("_n")))
    return numbered(taken.where("_n > 0"), "_n", "_j").select("_row.*")
