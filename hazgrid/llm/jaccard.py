"""Joins documents whose sets of word shingles have a Jaccard similarity of a threshold or more.

Tokens are shingles of `words` lower-cased words. The exchange of `corpus` counts in how many texts each token is, and
texts order their tokens by that count, rarest first. Two texts that are similar share all but a few tokens, so of the tokens that
they share, the first lies in the prefix of either, and the first k lie in the prefixes extended by k - 1 tokens. Tokens that one text
has alone can't be shared: they fill the prefix, need no entry, and a text with more of them than its prefix holds joins nothing.

Candidates. Rare tokens (in `rare` texts at most) of a prefix are indexed singly, so a bucket has a proven bound. Of frequent
tokens, combinations of k = 2 of the extended prefix are. If the first shared token is rare, its bucket has the pair; if not,
all shared tokens are frequent, and the combination of the first two has it. Pairs must also leave room for the overlap they need
after the places where they met. All candidates are verified on the whole sets.

Large groups of near copies. Before that, texts that agree in a min-hash of their shared tokens, or in all of their set, are each verified against one
hub: the one with the fewest tokens of its own, which is the group's most typical text. Texts that this connects are one component, and
the index then only looks for pairs across components, and drops the keys of only one. So a group of n copies costs about n checks.
That drops no component: every link between two components is still found. `linked` gives the links themselves, and so goes without hubs.

Null texts and texts without words have empty sets and join nothing; with fewer words the whole sequence is the token. Equal texts
are joined by their digest; ties are links (>=). Null doc_ids are joined, but name no component unless alone. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazgrid.llm import blocks as B
from hazgrid.llm import common as C
from hazgrid.llm import corpus as K
from hazgrid.llm.components import components

U = np.uint64


@dataclass(frozen=True)
class Join:
    words: int = 5
    percent: int = 80
    #: Tokens in more texts than this are frequent.
    rare: int = 64
    #: Min-hashes by which texts find hubs.
    hashes: int = 3

    def need(self, n):
        """The least overlap of a set of n with any similar set."""
        return -(-self.percent * n // 100)


def tokens_of(part: K.Part, join: Join) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of all texts, by text and hash; each one's text; and the sets' sizes."""
    data, at = C.data_of(part.text)
    w = B.find_words(B.LOWER[data], at)
    h = w.hashes()
    first, text = w.windows(join.words)
    short = np.flatnonzero((w.n > 0) & (w.n < join.words))
    token = np.concatenate([B.window_hashes(h, first, join.words), B.run_hashes(h, w.first[short], w.first[short + 1], 0xA0761D6478BD642F)])
    text = np.concatenate([text, short])
    order = np.lexsort((token, text))
    token, text = token[order], text[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (text[1:] != text[:-1])
    token, text = token[new], text[new]
    return token, text, np.bincount(text, minlength=len(at) - 1)


def counted(keys: np.ndarray) -> tuple[np.ndarray, None, np.ndarray]:
    """Distinct keys and how often each is there (255 at most). Sorted in place: a block has millions."""
    keys.sort()
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    return keys[first], None, np.minimum(np.diff(np.append(first, len(keys))), 255)


SETS = pa.schema([("tid", pa.int64()), ("n", pa.int64()), ("own", pa.int64()), ("tokens", pa.binary()), ("counts", pa.binary()), ("keys", pa.list_(pa.int64()))])


def sets_of(corpus: K.Corpus, join: Join) -> DataFrame:
    """For each text: its set's size, how many tokens it has alone, the others (rarest first) with their counts, and its hub keys.
    The last three are null where the text can join nothing."""
    bits = min(64, max(40, (corpus.n_bytes // 5).bit_length() + 13))
    shift = U(64 - bits)

    def keys_of(block: K.Block):
        held = [tokens_of(part, join)[0] >> shift for part in block.parts()]
        return counted(np.concatenate([np.zeros(0, U), *held]))

    def sets(block: K.Block, answers: pa.Table) -> pa.Table:
        keys, total = keys_of(block)[0], K.answered(answers)
        out = []
        for part in block.parts():
            token, text, n = tokens_of(part, join)
            count = total[np.searchsorted(keys, token >> shift)] if len(token) else np.zeros(0, np.uint8)
            own = np.bincount(text[count == 1], minlength=len(n))
            fits = (own <= n - join.need(n)) & (n > 0)
            keep = np.flatnonzero((count > 1) & fits[text])
            keep = keep[np.lexsort((token[keep], count[keep], text[keep]))]
            token, text, count = token[keep], text[keep], count[keep]
            at = np.searchsorted(text, np.arange(len(n) + 1))
            some = np.flatnonzero(at[1:] > at[:-1])
            hub = [np.minimum.reduceat(B.mixed(token, 20 + j), at[some]) for j in range(join.hashes)] if len(some) else []
            if len(some):
                hub.append(np.add.reduceat(B.mixed(token, 19), at[some]))  # the whole set, as all of its tokens are shared if another text has the same
            keys_at = dict(zip(some.tolist(), np.column_stack([B.mixed(x, 30 + j) for j, x in enumerate(hub)]).view(np.int64).tolist(), strict=True)) if len(some) else {}
            raw, raw_count = token.tobytes(), count.tobytes()
            spans = [(a, b) if i in keys_at else None for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))]
            out.append(pa.RecordBatch.from_arrays([
                pa.array(part.tids), pa.array(n, pa.int64()), pa.array(own, pa.int64()), pa.array([s and raw[8 * s[0] : 8 * s[1]] for s in spans], pa.binary()), pa.array([s and raw_count[s[0] : s[1]] for s in spans], pa.binary()), pa.array([keys_at.get(i) for i in range(len(n))], SETS.field("keys").type),
            ], schema=SETS))
        return pa.Table.from_batches(out, schema=SETS)

    return C.written(K.each_block(corpus, sets, "tid long, n long, own long, tokens binary, counts binary, keys array<long>", K.exchanged(corpus, keys_of, bits)), "sets")


def hub_pairs(sets: DataFrame) -> DataFrame:
    """a, b: each text with the hubs of its keys."""
    keyed = sets.where("tokens is not null").select("tid", (F.col("own") / F.col("n")).alias("alone"), F.explode("keys").alias("key"))
    # Written, so that the join has a plain exchange on either side, which AQE can split at a key of very many texts.
    hubs = C.written(keyed.groupBy("key").agg(F.min(F.struct("alone", "tid"))["tid"].alias("b"), F.count("*").alias("c")).where("c > 1").drop("c"), "hubs")
    return keyed.join(hubs, "key").where("tid <> b").select(F.col("tid").alias("a"), "b").distinct()


def verified(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """u, v: the pairs (a, b) that are similar, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in C.cut(batches, "left"):
            a, b, m, n = (batch.column(c).to_numpy() for c in ("a", "b", "m", "n"))
            left, right = batch.column("left"), batch.column("right")
            keep = np.zeros(len(a), bool)
            for i in range(len(a)):
                if b[i] != last:
                    last, held = b[i], np.sort(np.frombuffer(right[i].as_buffer(), U))
                x = np.frombuffer(left[i].as_buffer(), U)
                at = np.minimum(np.searchsorted(held, x), len(held) - 1)
                keep[i] = int((held[at] == x).sum()) * (100 + join.percent) >= join.percent * (m[i] + n[i])
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["u", "v"])

    own = sets.select("tid", "n", "tokens")
    both = pairs.join(own.toDF("a", "m", "left"), "a").join(own.toDF("b", "n", "right"), "b")
    both = both.where(F.greatest("m", "n") * join.percent <= F.least("m", "n") * 100)
    return both.select("a", "b", "m", "n", "left", "right").mapInArrow(run, "u long, v long")


def prefixes(sets: DataFrame, join: Join) -> DataFrame:
    """A row for each token of an extended prefix: key, tid, n, place, room (tokens from there on), whether it is in the plain prefix, and whether it is frequent."""
    kind = C.arrow_schema("key long, tid long, n long, place long, room long, plain boolean, frequent boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.cut(batches, "tokens", 4 << 20):
            tid, size, alone = (batch.column(c).to_numpy() for c in ("tid", "n", "own"))
            shared = np.diff(C.offsets_of(batch.column("tokens"))) // 8
            plain = np.minimum(shared, size - join.need(size) + 1 - alone)
            longer = np.minimum(shared, plain + 1)
            row = np.repeat(np.arange(len(tid)), longer)
            place = np.arange(len(row)) - np.repeat(np.cumsum(longer) - longer, longer)
            raw = [np.frombuffer(x.as_buffer(), U, int(n)) for x, n in zip(batch.column("tokens"), longer, strict=True)]
            counts = [np.frombuffer(x.as_buffer(), np.uint8, int(n)) for x, n in zip(batch.column("counts"), longer, strict=True)]
            yield C.made(kind, key=np.concatenate(raw).view(np.int64), tid=tid[row], n=size[row], place=place, room=shared[row] - place, plain=place < plain[row], frequent=np.concatenate(counts) > join.rare)

    return sets.where("tokens is not null").select("tid", "n", "own", "tokens", "counts").mapInArrow(run, "key long, tid long, n long, place long, room long, plain boolean, frequent boolean")


def combined(tokens: DataFrame) -> DataFrame:
    """An entry for each pair of frequent tokens of a text (key, tid, n, component, room), the first of them in its plain prefix."""
    schema = "key long, tid long, n long, component long, room long"
    kind = C.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, own = batch.column("held"), [batch.column(c).to_numpy() for c in ("tid", "n", "component")]
            at = C.offsets_of(held)
            token, plain, room = (held.values.field(c).to_numpy(zero_copy_only=False) for c in ("key", "plain", "room"))
            token = B.mixed(token.view(U), 43)
            for row, (begin, end) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                # Places are in order, so those of the plain prefix come first.
                firsts = min(int(plain[begin:end].sum()), end - begin - 1)
                for i in range(begin, begin + firsts):
                    key = B.mixed(B.mixed(token[i : i + 1], 41) + token[i + 1 : end], 42).view(np.int64)
                    yield C.made(kind, key=key, room=np.full(len(key), room[i]), **{c: np.full(len(key), v[row]) for c, v in zip(("tid", "n", "component"), own, strict=True)})

    held = tokens.groupBy("tid", "n", "component").agg(F.array_sort(F.collect_list(F.struct("place", "key", "room", "plain"))).alias("held")).where(F.size("held") > 1)
    return held.mapInArrow(run, schema)


def component_of(tids: DataFrame, found: DataFrame) -> DataFrame:
    return tids.join(found.withColumnRenamed("node", "tid"), "tid", "left").withColumn("component", F.coalesce("component", "tid"))


def fits(join: Join) -> Column:
    return F.least("x.room", "y.room") * (100 + join.percent) >= join.percent * (F.col("x.n") + F.col("y.n"))


def several(rows: DataFrame) -> DataFrame:
    """Rows whose key more than one component has. The keys are written, so that the join has plain exchanges."""
    keys = C.written(rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key"), "keys")
    return C.written(rows.join(keys, "key"), "entries")


def cross_pairs(sets: DataFrame, found: DataFrame, join: Join) -> DataFrame:
    """a, b: candidates of two components.

    What two texts of different components share is in both their prefixes, so a token that the prefixes of one component have alone is left out, before tokens are combined.
    """
    tokens = several(component_of(prefixes(sets, join), found))
    columns = ["key", "tid", "n", "component", "room"]
    e = tokens.where("plain and not frequent").select(*columns).unionByName(several(combined(tokens.where("frequent"))).select(*columns))
    x, y = e.alias("x"), e.alias("y")
    return x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") < F.col("y.component")) & fits(join)).select(F.col("x.tid").alias("a"), F.col("y.tid").alias("b")).distinct()


def linked(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """Every link: a and b (the least doc_ids of two classes of equal sets, a's class having the lesser tid), and n_links, the pairs of documents that it stands for.

    A class of several documents has a row of its own (a = b), for the pairs within. The sum of n_links is the number of similar pairs of documents.
    All pairs of classes are candidates, also those that hubs would connect, so the rows grow with the links there are.
    """
    spark = docs.sparkSession
    corpus = K.corpus_of(docs, "shingles")
    sets = sets_of(corpus, join)
    C.discard(spark, corpus.folder)
    # Sets with tokens of their own equal no other; the order of tokens is the same in equal sets.
    same = F.when((F.col("own") == 0) & F.col("tokens").isNotNull(), F.sha2("tokens", 256)).otherwise(F.col("tid").cast("string"))
    keyed = sets.where("n > 0").select("tid", same.alias("same"))
    class_of = C.written(keyed.join(keyed.groupBy("same").agg(F.min("tid").alias("class")), "same").select("tid", "class"), "classes")
    size = corpus.rows.join(corpus.texts.select("tid", "digest"), "digest").join(class_of, "tid").groupBy("class").agg(F.min("doc_id").alias("name"), F.count("*").alias("size"))
    size = C.written(size, "class-sizes")
    heads = C.written(sets.join(class_of.where("tid = class").select("tid"), "tid"), "class-sets")
    none = class_of.where("false").select(F.col("tid").alias("node"), F.col("class").alias("component"))
    with C.arrow_rows(spark, 256):
        found = C.written(verified(cross_pairs(heads, none, join), heads, join), "all-links")
    C.discard(spark, sets.written_at)
    x, y = (size.select(F.col("class").alias(c), F.col("name").alias(n), F.col("size").alias(s)) for c, n, s in (("u", "a", "m"), ("v", "b", "n")))
    between = found.join(x, "u").join(y, "v").select("a", "b", (F.col("m") * F.col("n")).alias("n_links"))
    return between.unionByName(size.where("size > 1").select(F.col("name").alias("a"), F.col("name").alias("b"), F.expr("size * (size - 1) div 2").alias("n_links")))


def grouped(docs: DataFrame, join: Join, sizes: K.Sizes = K.Sizes()) -> DataFrame:
    """One row a document: doc_id, digest, n (the size of its set) and component, a number that its texts share; written."""
    spark = docs.sparkSession
    corpus = K.corpus_of(docs, "shingles", sizes)
    sets = sets_of(corpus, join)
    C.discard(spark, corpus.folder)
    with C.arrow_rows(spark, 256):
        links = C.written(verified(hub_pairs(sets), sets, join), "hub-links")
    pairs = cross_pairs(sets, components(links), join)
    with C.arrow_rows(spark, 256):
        more = C.written(verified(pairs, sets, join), "more-links")
    found = components(links.unionByName(more))
    texts = component_of(corpus.texts.select("tid", "digest").join(sets.select("tid", "n"), "tid"), found)
    rows = C.written(corpus.rows.join(texts, "digest"), "named")
    C.discard(spark, sets.written_at)
    return rows


def near_duplicates(docs: DataFrame, join: Join = Join(), sizes: K.Sizes = K.Sizes()) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the least doc_id that links reach), and its text's digest."""
    rows = grouped(docs, join, sizes)
    names = C.written(rows.groupBy("component").agg(F.min("doc_id").alias("name")), "names")
    return rows.join(names, "component").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("doc_id")).alias("component_id"), "digest")


def one_of_each(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """One document of each component (of the least doc_id, nulls last, then of the least digest), and those without words. All columns are kept.

    Null doc_ids stay only if no other document is in the component.
    """
    own = docs.columns
    least = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("digest").alias("_digest")))
    name = C.written(grouped(docs, join).where("n > 0").groupBy("component").agg(least.alias("x")).select("x.*"), "names")
    held = docs.select(F.struct(*[docs[c] for c in own]).alias("_row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(0)).alias("_id"), docs["doc_id"].isNull().alias("_null"), F.coalesce(docs["text"], F.lit("")).alias("_text"))
    held = held.withColumn("_digest", F.unhex(F.sha2("_text", 256))).drop("_text")
    words = F.coalesce(F.col("_row.text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = held.where(words).join(name, ["_id", "_null", "_digest"]).groupBy("_id", "_null", "_digest").agg(F.first("_row").alias("_row"))
    return kept.select("_row.*").unionByName(held.where(~words).select("_row.*"))
