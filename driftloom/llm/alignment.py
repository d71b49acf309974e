"""Alignment of two tokenizations of each text.

A text is cut at single spaces, where both vocabularies end a token whatever stands around (see ``vocab``), so its alignment
is that of its pieces, one after the other.  Python only tokenizes pieces; the rest is Spark's functions:

1. Words between spaces are counted over all texts.  Those that come most often (``KNOWN`` at most, twice or more) are tokenized and
   aligned once each; the results are arrays by number, known to all tasks as scalar subqueries.
2. For every text, Python gives the numbers of its pieces, and tokenizes those that aren't known.
3. A text's own pieces are aligned where it lies, and it is put together by the numbers.

Pieces are aligned by higher-order functions (``grouped``).  ``array_intersect`` of the two arrays of ends gives the offsets where
both end a token, and so the groups.  Where a group ends within either array follows from sorting the array's ends
together with the common ones (two ascending runs).  ``transform`` over these places slices the groups, ``aggregate``
counts links, and nested ``transform`` makes the linked pairs of ids.  A pair is one number with how often it's linked; a
text holds its pieces' numbers in order.

What the whole corpus says of a pair (in how many texts it's linked, and whether that's the most for its A id) is
grouped once, after partial sums within tasks.  Texts get it back by a broadcast of the pairs, if there are
``FREQUENT`` at most; beyond that the most frequent ones are broadcast and the rest, which few texts hold, are
joined by shuffle, so no frequent pair is ever a join key in one task.

A group with more than ``WIDE`` links (texts that hardly share a token's end) is first reduced to the
different ids of either side, so that links are counted, not made.

Cases: null and empty texts, and texts that either vocabulary doesn't give back byte for byte, have no tokens (zeros and an
empty hash); special tokens' strings are plain text; ids may be null or repeated (rows are rows); texts of any
length are taken whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vocab import byte_level, byte_tokens, different, piece_tokens, pieces_of_words, vocabulary
from .words import chunks, documents, ensure_checkpoint_dir, give_back, texts_of

SHORT = 64  # characters of a piece that may be aligned beforehand
KNOWN = 1 << 19  # pieces aligned beforehand at most
MEMO = 20_000  # pieces an encoder remembers: those that come often are known
WIDE = 4096
FREQUENT = 1 << 20
SHIFT = 31  # a pair takes 32 bits, the number of its links the rest
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.enable.dictionary": "false",
}


class Places:
    """Places of texts in a large binary array, found by sorted hashes: a dictionary would take several times the array's bytes in every worker.

    Of different texts with one hash only one is found.
    """

    def __init__(self, listed: pa.Array) -> None:
        slices = (listed.slice(k, 1 << 14).to_pylist() for k in range(0, len(listed), 1 << 14))
        hashes = np.fromiter((hash(x) for some in slices for x in some), np.int64, len(listed))
        self.listed, self.order = listed, np.argsort(hashes).astype(np.int32)
        self.hashes = hashes[self.order]

    def of(self, texts: list[bytes]) -> np.ndarray:
        """The place of each text, -1 where it isn't found."""
        out = np.full(len(texts), -1, np.int64)
        if len(self.listed):
            h = np.fromiter(map(hash, texts), np.int64, len(texts))
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == h)
            place = self.order[at[hit]]
            same = pa.compute.equal(pa.array([texts[i] for i in hit], pa.large_binary()), self.listed.take(pa.array(place)))
            same = same.to_numpy(zero_copy_only=False).astype(bool)
            out[hit[same]] = place[same]
        return out


def _sides(a_path: str, b_path: str) -> list[tuple[Callable, list[bytes], np.ndarray]]:
    """Of both vocabularies the encoder, the bytes of each id, and their number."""
    sides = (byte_level(a_path, special=False, memo=MEMO), byte_tokens(a_path)), (pieces_of_words(b_path, memo=MEMO), piece_tokens(b_path))
    return [(encode, parts, np.array([len(x) for x in parts], np.int64)) for encode, parts in sides]


def _encoded(texts: list[bytes], sides: list[tuple[Callable, list[bytes], np.ndarray]]) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """For both vocabularies all ids, how many come before each text, how many bytes before each id; and which texts they give back."""
    ends = np.cumsum([len(x) for x in texts])
    found, good = [], np.ones(len(texts), bool)
    for encode, parts, size in sides:
        ids, before = encode(texts)
        at = np.concatenate(([0], np.cumsum(size[ids])))
        joined = b"".join(map(parts.__getitem__, ids.tolist()))
        if not (np.array_equal(at[before[1:]], ends) and joined == b"".join(texts)):
            good &= [joined[at[a] : at[b]] == x for a, b, x in zip(before, before[1:], texts)]
        found.append((ids, before, at))
    return found, good


def _lists(n: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(values.astype(np.int32)))


def tokens(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, a_ids, a_ends, b_ids, b_ends (in bytes of a space and the text) of every row of docs (doc_id, text)."""
    kind = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([docs.select("doc_id").schema[0], *[T.StructField(x, kind, False) for x in ("a_ids", "a_ends", "b_ids", "b_ends")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(a_path, b_path)
        for rows in chunks(batches, "text"):
            found, good = _encoded([b" " + x if x else b"" for x in texts_of(rows.column("text"))], sides)
            columns = []
            for ids, before, at in found:
                n = np.diff(before)
                keep = np.repeat(good, n)
                own = (at[1:] - np.repeat(at[before[:-1]], n))[keep]
                columns += [_lists(np.where(good, n, 0), x) for x in (ids[keep], own)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *columns], schema.names)
            give_back()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def parts(docs: DataFrame, known: Broadcast, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, pieces, p_ends, a_ids, a_ends, b_ids, b_ends of every row of docs (doc_id, text).

    known has a list or Arrow array of pieces (bytes, with the space before) and the numbers of their tokens on either side.  ``pieces`` has the
    place of each piece in known, or -1 - k for the k-th that isn't there; of these, one after the other, the tokens and where each ends,
    and where the pieces end, in bytes.
    """
    names = ["pieces", "p_ends", "a_ids", "a_ends", "b_ids", "b_ends"]
    kind = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([docs.select("doc_id").schema[0], *[T.StructField(x, T.LongType(), False) for x in ("n_a", "n_b")], *[T.StructField(x, kind, False) for x in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, cut = _sides(a_path, b_path), pieces_of_words(b_path, memo=MEMO).pieces
        listed, *sizes = known.value
        places = Places(listed if isinstance(listed, pa.Array) else pa.array(listed, pa.large_binary()))
        for rows in chunks(batches, "text"):
            found, first = cut([b" " + x if x else b"" for x in texts_of(rows.column("text"))])
            which, names_here = different(found)
            code = places.of(names_here)
            own = np.flatnonzero(code < 0)
            encoded, good = _encoded([names_here[i] for i in own], sides)
            lost = np.zeros(len(names_here), bool)
            lost[own] = ~good
            whole = np.diff(np.concatenate(([0], np.cumsum(lost[which])))[first]) == 0  # all pieces are given back
            n = np.where(whole, np.diff(first), 0)
            text = np.repeat(np.arange(len(whole)), np.diff(first))
            which, text = which[whole[text]], text[whole[text]]
            number = code[which]
            rest = np.flatnonzero(number < 0)
            of = np.bincount(text[rest], minlength=len(whole))  # unknown pieces of each text
            number[rest] = -1 - (np.arange(len(rest)) - np.repeat(np.cumsum(of) - of, of))
            index = np.zeros(len(names_here), np.int64)
            index[own] = np.arange(len(own))
            index = index[which[rest]]
            size = np.array([len(names_here[i]) for i in own], np.int64)[index]
            begin = np.cumsum(size) - size
            begin -= np.repeat(begin[np.minimum(np.cumsum(of) - of, max(len(rest) - 1, 0))], of) if len(rest) else 0
            columns, counts = [_lists(n, number), _lists(of, begin + size)], []
            for (ids, before, at), held in zip(encoded, sizes):
                k = np.diff(before)[index]
                pick = np.repeat(before[index] - (np.cumsum(k) - k), k) + np.arange(k.sum())
                ends = at[pick + 1] + np.repeat(begin - at[before[index]], k)
                each = np.bincount(text[rest], weights=k, minlength=len(whole)).astype(np.int64)
                columns += [_lists(each, ids[pick]), _lists(each, ends)]
                seen = number >= 0
                counts.append(pa.array(each + np.bincount(text[seen], weights=held[number[seen]], minlength=len(whole)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *counts, *columns], schema.names)
            give_back()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _places(ends: Column, common: Column) -> Column:
    """For each of the common ends, how many of the array's ends are no greater."""
    both = F.sort_array(F.concat(F.transform(ends, lambda e: e * 2), F.transform(common, lambda c: c * 2 + 1)))
    marks = F.filter(F.transform(both, lambda x, i: F.when(x.bitwiseAND(1) == 1, i).otherwise(-1)), lambda i: i >= 0)
    return F.transform(marks, lambda p, k: p - k)


def _starts(places: Column) -> Column:
    """The place before each, 0 before the first."""
    return F.when(F.size(places) == 0, places).otherwise(F.concat(F.array(F.lit(0)), F.slice(places, 1, F.size(places) - 1)))


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once for the row, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _different(ids: Column) -> Column:
    """The different entries of an array in order, each with its number of times."""

    def from_sorted(x: Column) -> Column:
        last = F.filter(F.transform(x, lambda v, i: F.when(v == F.get(x, i + 1), -1).otherwise(i)), lambda i: i >= 0)
        count = lambda e: F.transform(e, lambda i, k: F.struct(F.get(x, i).cast("long").alias("id"), (i - F.when(k == 0, -1).otherwise(F.get(e, k - 1))).cast("long").alias("n")))
        return _with(last, count)

    return _with(F.sort_array(ids), from_sorted)


def grouped(rows: DataFrame, others: Sequence[str] = ()) -> DataFrame:
    """rows (doc_id, a_ids, a_ends, b_ids, b_ends, others) as doc_id, n_a, n_b, n_groups, n_links, groups (text), _links and others.

    Where rows have p_ends, groups is an array of the texts of the groups up to each of these ends (which both sides share).

    _links has a number for each link: its pair of ids, shifted by SHIFT, plus one.  Of a group of more than WIDE links it has one for each
    different pair, plus how often that is linked.
    """
    # Catalyst writes a column that a later select uses once into that use, even into a lambda, which would make it anew for
    # each entry; _with binds what lambdas read.
    by_piece = "p_ends" in rows.columns
    others = [*others, *["p_ends"] * by_piece]
    common = rows.select("doc_id", *others, "a_ids", "b_ids", "a_ends", "b_ends", F.array_intersect("a_ends", "b_ends").alias("_c"))
    if by_piece:
        common = common.withColumn("_p", _places(F.col("_c"), F.col("p_ends")))
        others = [x for x in others if x != "p_ends"] + ["_p"]
    cut = common.select("doc_id", *others, "a_ids", "b_ids", _places(F.col("a_ends"), F.col("_c")).alias("_a"), _places(F.col("b_ends"), F.col("_c")).alias("_b"))
    cut = cut.select("*", _starts(F.col("_a")).alias("_i"), _starts(F.col("_b")).alias("_j"))
    sizes = _with(F.struct("_a", "_b", "_i", "_j"), lambda g: F.transform(g["_i"], lambda i, k: (F.get(g["_a"], k) - i).cast("long") * (F.get(g["_b"], k) - F.get(g["_j"], k))))
    cut = cut.select("*", sizes.alias("_w"))
    held = F.struct("a_ids", "b_ids", "_a", "_b", "_i", "_j", "_w")

    # Of group k, i is the place of its first A token, _w its number of links; most groups are one token on either side.
    def a_side(g: Column, i: Column, k: Column) -> Column:
        return F.slice(g["a_ids"], i + 1, F.get(g["_a"], k) - i)

    def b_side(g: Column, k: Column) -> Column:
        return F.slice(g["b_ids"], F.get(g["_j"], k) + 1, F.get(g["_b"], k) - F.get(g["_j"], k))

    def text(g: Column, i: Column, k: Column) -> Column:
        one = F.concat(F.get(g["a_ids"], i).cast("string"), F.lit("|"), F.get(g["b_ids"], F.get(g["_j"], k)).cast("string"))
        more = F.concat(F.array_join(a_side(g, i, k).cast("array<string>"), ","), F.lit("|"), F.array_join(b_side(g, k).cast("array<string>"), ","))
        return F.when(F.get(g["_w"], k) == 1, one).otherwise(more)

    def pairs(g: Column, i: Column, k: Column) -> Column:
        pair = lambda u, v: F.shiftleft(u.cast("long") * 65536 + v, SHIFT) + 1
        more = F.flatten(F.transform(a_side(g, i, k), lambda u: F.transform(b_side(g, k), lambda v: pair(u, v))))
        one = F.array(pair(F.get(g["a_ids"], i), F.get(g["b_ids"], F.get(g["_j"], k))))
        return F.when(F.get(g["_w"], k) == 1, one).when(F.get(g["_w"], k) <= WIDE, more).otherwise(F.array().cast("array<bigint>"))

    def reduced(g: Column, k: Column) -> Column:
        one = lambda u, bs: F.transform(bs, lambda v: F.shiftleft(u["id"] * 65536 + v["id"], SHIFT) + u["n"] * v["n"])
        return _with(_different(b_side(g, k)), lambda bs: F.flatten(F.transform(_different(a_side(g, F.get(g["_i"], k), k)), lambda u: one(u, bs))))

    wide = F.filter(F.transform("_w", lambda w, k: F.when(w > WIDE, k).otherwise(-1)), lambda k: k >= 0)
    linked = cut.select(
        "doc_id",
        *others,
        F.size("a_ids").cast("long").alias("n_a"),
        F.size("b_ids").cast("long").alias("n_b"),
        F.size("_w").cast("long").alias("n_groups"),
        F.aggregate("_w", F.lit(0).cast("long"), lambda n, x: n + x).alias("n_links"),
        _with(held, lambda g: F.transform(g["_i"], lambda i, k: text(g, i, k))).alias("_t"),
        F.flatten(_with(held, lambda g: F.transform(g["_i"], lambda i, k: pairs(g, i, k)))).alias("_s"),
        F.when(F.array_max("_w") > WIDE, _with(F.struct(held.alias("g"), wide.alias("at")), lambda x: F.flatten(F.transform(x["at"], lambda k: reduced(x["g"], k))))).alias("_wide"),
    )
    both = F.when(F.col("_wide").isNull(), F.col("_s")).otherwise(F.concat("_s", "_wide"))
    groups = F.array_join("_t", ";")
    if by_piece:
        one = lambda g, e, h: F.when(e - h == 1, F.get(g["_t"], h)).otherwise(F.array_join(F.slice(g["_t"], h + 1, e - h), ";"))
        groups = _with(F.struct("_t", "_p"), lambda g: F.transform(g["_p"], lambda e, k: one(g, e, F.when(k == 0, 0).otherwise(F.get(g["_p"], k - 1)))))
    return linked.select("doc_id", "n_a", "n_b", "n_groups", "n_links", groups.alias("groups"), both.alias("_links"), *[x for x in others if x != "_p"])


def aligned(docs: DataFrame, known: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (text) and _links of every row of docs (doc_id, text).

    known has what ``grouped`` gives for some pieces as doc_id, few enough for every task to hold.
    """
    known = known.where((F.col("n_a") > 0) & (F.col("n_links") == F.size("_links")))
    told = known.orderBy("doc_id").select(F.concat(F.lit(" "), "doc_id").cast("binary"), "n_a", "n_b").toArrow().combine_chunks()
    listed = pa.concat_arrays([pa.array([], pa.large_binary()), *told.column(0).cast(pa.large_binary()).chunks])
    held = docs.sparkSession.sparkContext.broadcast((listed, *(told.column(k).to_numpy().astype(np.int32) for k in (1, 2))))
    results = known.agg(F.sort_array(F.collect_list(F.struct("doc_id", "groups", "_links"))).alias("x"))
    texts, links = results.select("x.groups").scalar(), results.select("x._links").scalar()  # in the same order
    rows = parts(docs, held, a_path, b_path).withColumnsRenamed({"n_a": "_n_a", "n_b": "_n_b"})
    # Each of the subqueries' columns is used once, so Catalyst writes it into its use: the arrays are referred to, not copied into rows.
    made = grouped(rows, ["_n_a", "_n_b", "pieces"]).select("*", texts.alias("_texts"), links.alias("_of"))
    whole = _with(F.struct("pieces", "groups", "_texts"), lambda g: F.transform(g["pieces"], lambda p: F.when(p >= 0, F.get(g["_texts"], p)).otherwise(F.get(g["groups"], -1 - p))))
    seen = F.flatten(_with(F.struct("pieces", "_of"), lambda g: F.transform(F.filter(g["pieces"], lambda p: p >= 0), lambda p: F.get(g["_of"], p))))
    made = made.select("doc_id", "_n_a", "_n_b", "n_groups", "n_links", "_links", F.array_join(whole, ";").alias("groups"), seen.alias("_seen"))
    n_groups = F.when(F.col("_n_a") == 0, 0).otherwise(F.length("groups") - F.length(F.replace("groups", F.lit(";"))) + 1)
    return made.select(
        "doc_id", F.col("_n_a").alias("n_a"), F.col("_n_b").alias("n_b"), n_groups.cast("long").alias("n_groups"), (F.col("n_links") + F.size("_seen")).alias("n_links"), "groups",
        F.sort_array(F.concat("_links", "_seen")).alias("_links"),
    )


def pair_counts(rows: DataFrame) -> DataFrame:
    """a, _pair, n (texts that link the pair), best (n is the most for this a) over rows (_pairs, the different pairs of a text, as in _links)."""
    counts = rows.select(F.explode("_pairs").alias("_x")).groupBy(F.shiftright("_x", SHIFT).alias("_pair")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("a", F.floor(F.col("_pair") / 65536)).checkpoint(eager=True)
    most = counts.groupBy("a").agg(F.max("n").alias("_most"))  # no more rows than A has ids
    return counts.join(F.broadcast(most), "a").select("a", "_pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def _frequent_from(counts: DataFrame, limit: int) -> int:
    """The least power of two that n of ``limit`` rows of counts at most reaches."""
    bits = counts.groupBy(F.length(F.bin("n")).alias("k")).count().collect()  # 64 rows at most
    total = 0
    for k, n in sorted(((r.k, r["count"]) for r in bits), reverse=True):
        total += n
        if total > limit:
            return 1 << k
    return 1


def scored(rows: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """_row, n_best and count_sum over rows (_row, _links); texts without links are missing."""
    low = F.lit((1 << SHIFT) - 1).cast("long")
    each = rows.select("_row", F.explode("_links").alias("_x")).select("_row", F.shiftright("_x", SHIFT).alias("_pair"), F.col("_x").bitwiseAND(low).alias("_t"))
    table = counts.select("_pair", "n", "best")
    cut = _frequent_from(table, frequent)
    hits = each.join(F.broadcast(table.where(F.col("n") >= cut)), "_pair")
    if cut > 1:
        rest = table.where(F.col("n") < cut)
        rare = each.join(F.broadcast(table.where(F.col("n") >= cut)), "_pair", "left_anti").join(rest.hint("shuffle_hash"), "_pair")
        hits = hits.select("_row", "_t", "n", "best").unionByName(rare.select("_row", "_t", "n", "best"))
    return hits.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("_t")).otherwise(0)).alias("n_best"), F.sum(F.col("_t") * F.col("n")).alias("count_sum"))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/aligned-{uuid.uuid4().hex}"
    a_path, b_path = a_path or vocabulary("byte_bpe_50k.json"), b_path or vocabulary("piece_bpe_32k.model")

    def written(rows: DataFrame, name: str) -> DataFrame:
        rows.write.options(**LAYOUT).parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    words = docs.select(F.explode(F.split("text", " ")).alias("_piece")).where((F.col("_piece") != "") & (F.length("_piece") <= SHORT))
    counts = written(words.groupBy("_piece").agg(F.count("*").alias("n")).where("n > 1"), "words")
    common = counts.where(F.col("n") >= _frequent_from(counts, min(frequent, KNOWN))).select(F.col("_piece").alias("doc_id"), F.col("_piece").alias("text"))
    known = written(grouped(tokens(common.repartition("doc_id"), a_path, b_path)), "known")
    made = aligned(docs, known, a_path, b_path)
    digest = F.when(F.col("n_a") == 0, F.lit("")).otherwise(F.sha2("groups", 256))
    # A pair that a wide group links may stand there with different numbers of links; such a text also keeps its different pairs.
    bare = F.transform("_links", lambda x: F.shiftleft(F.shiftright(x, SHIFT), SHIFT))
    different = F.when(F.col("n_links") != F.size("_links"), F.array_distinct(bare)).alias("_different")
    rows = written(made.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "_links", different), "texts")
    pairs = pair_counts(rows.select(F.coalesce("_different", F.array_distinct("_links")).alias("_pairs")))
    sums = scored(rows, pairs, frequent).withColumnRenamed("_row", "_r")
    joined = rows.drop("_links", "_different").join(sums, F.col("_row") == F.col("_r"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))
