"""Exact n-gram Jaccard join by a token-group matrix; components of its links.

Tokens are 64-bit hashes of word shingles.  Documents with equal token sets are one class (128-bit
signature); everything below works on one representative of each class, so copies cost nothing.

Only two texts that share enough of their first tokens can reach the similarity: in any one order
of all tokens, texts S and S' with Jaccard similarity t or more share the first l common tokens
within the first |S| - ceil(t |S|) + l tokens of each.  The order is rare first (tokens of a share
of ``HOT`` of all documents or more come last; at most about 1/HOT times a text's tokens, so the
list is bounded and broadcast), then by hash.

1.  Prefilter: a document stays if enough tokens of its prefix are in some other class's prefix.
2.  Groups: the survivors are partitioned into groups of similar documents, by two min-hash keys;
    large keys are cut into chunks of ``CHUNK`` sets (and ``CHUNK_TOKENS`` tokens) that share one pivot;
    members of a key are counted by salted keys, so a large key's don't meet in one task.  A task
    links the members of a chunk: the pivot against all, then every document outside the largest
    component against all; so all links of a chunk are found up to those inside a component known.
3.  Token-group matrix: the groups now are the components found, and the chunks of the first key for
    documents that are linked with nothing yet.  Each group's token union (here of prefix tokens)
    is stored by token.  A document is matched with the unions of all groups but its own; the
    number of shared tokens bounds its overlap with any member, and only groups whose bound
    qualifies are opened.  Of two groups the documents of the smaller component ask.  In an opened group (cut into chunks) the bound is
    taken again over the full union, and then members are compared exactly.

Nothing is emitted for pairs within a group, and links lost between groups are only those of
texts that are in one component already.

Cases: null texts and texts without words have an empty set and are linked with nothing; rows
without an id have no component (null) and link nothing; repeated ids are one document if their
sets are equal, else an id takes part with each of its sets; ties go to the smaller id; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .substring_dedup import deltas, squeeze, unsqueeze
from .words import HashMemo, checkpointed, chunks, documents, give_back, scramble, texts_of, unused, window_hashes

HOT = 0.001
CHUNK = 1024
QUERIES = 4096
CHUNK_TOKENS = 1 << 21  # tokens of a chunk or of a slice of queries at most, but for one longer set
SALTS = 64
FILTER_BITS = 1 << 26  # bits of the prefilter's bitmap at most


class Rule:
    """Shingle width and threshold (num / den), and the prefix arithmetic that follows from them."""

    def __init__(self, width: int, num: int, den: int = 100) -> None:
        self.width, self.num, self.den = width, num, den

    def share(self, n):
        """Common tokens that a prefix is extended by."""
        return np.maximum(1, n // 20)

    def prefix(self, n):
        return np.minimum(n, n + (-self.num * n) // self.den + self.share(n))

    def needed(self, n):
        """Shared prefix tokens that any partner has: partners have num/den of n tokens at least."""
        return self.share(-(-self.num * n // self.den))

    def linked(self, both, n, m):
        return self.den * both >= self.num * (n + m - both)


def token_sets(texts: list[bytes], width: int, memo: HashMemo) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, text of each), distinct and sorted within a text."""
    split = [t.lower().split() for t in texts]  # bytes.lower() changes A-Z only
    sizes = np.array([len(w) for w in split], np.int64)
    h = memo.hashes([w for ws in split for w in ws])
    doc = np.repeat(np.arange(len(texts)), sizes)
    a = window_hashes(h, width, 0x3D0C)
    inside = doc[: len(a)] == doc[width - 1 :][: len(a)]
    tok, own = [a[inside]], [doc[: len(a)][inside]]
    for k in range(1, width):  # texts of fewer words are one token
        short = np.flatnonzero(sizes == k)
        if len(short):
            at = (np.cumsum(sizes) - sizes)[short]
            tok.append(np.array([window_hashes(h[i : i + k], k, 0x3D0C + k)[0] for i in at], np.uint64))
            own.append(short)
    tok, own = np.concatenate(tok), np.concatenate(own)
    order = np.argsort(tok)
    tok, own = tok[order], own[order]
    order = np.argsort(own, kind="stable")
    tok, own = tok[order], own[order]
    keep = np.ones(len(tok), bool)
    keep[1:] = (tok[1:] != tok[:-1]) | (own[1:] != own[:-1])
    return tok[keep], own[keep]


def _per_text(tok: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.bincount(own, minlength=n)
    return size, np.cumsum(size) - size


def _reduce(ufunc, values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.zeros(len(size), np.uint64)
    full = size > 0
    if full.any():
        out[full] = ufunc.reduceat(values, first[full])
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


FEATURES = "doc_id long, n long, s1 long, s2 long, k1 long, k2 long, bucket int, many int, packed binary"
BUCKETS = 32


def merged(seen: np.ndarray, count: np.ndarray, fresh: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens with their counts, after more of them."""
    new, c = np.unique(np.concatenate([np.empty(0, np.uint64), *fresh]), return_counts=True)
    many = c > 1
    at = np.searchsorted(seen, new)
    known = at < len(seen)
    known[known] = seen[at[known]] == new[known]
    count = count.copy()
    count[at[known]] += c[known]
    # A token met once is kept only if it was known: the share asked for is far above that.
    add = many & ~known
    both, n = np.concatenate([seen, new[add]]), np.concatenate([count, c[add]])
    order = np.argsort(both)
    return both[order], n[order]


def features(docs: DataFrame, rule: Rule) -> DataFrame:
    """A row for each document (size, signature, two min-hash keys), and packed rows of tokens that a partition repeats (bucket not null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, rows = HashMemo(), 0
        seen, count, fresh = np.empty(0, np.uint64), np.empty(0, np.int64), []
        names = [x.split()[0] for x in FEATURES.split(", ")]
        for part in chunks(batches, "text"):
            n = part.num_rows
            tok, own = token_sets(texts_of(part.column("text")), rule.width, memo)
            size, first = _per_text(tok, own, n)
            sums = [_reduce(np.add, scramble(tok, c), first, size) for c in (0x11, 0x22)]
            keys = [_reduce(np.minimum, scramble(tok, c), first, size) for c in (0x33, 0x44)]
            none = [pa.nulls(n, kind) for kind in (pa.int32(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(size.astype(np.int64)), *map(_signed, (*sums, *keys)), *none], names)
            rows += n
            fresh.append(tok)
            if sum(map(len, fresh)) > 1_000_000:
                seen, count = merged(seen, count, fresh)
                fresh = []
                keep = count >= max(2, HOT * rows / 4)  # others cannot have the share so far
                seen, count = seen[keep], count[keep]
        seen, count = merged(seen, count, fresh)
        keep = count >= max(2, HOT * rows / 2)
        seen, count = seen[keep], count[keep]
        edges = np.searchsorted(seen, np.arange(BUCKETS, dtype=np.uint64) << np.uint64(59)).tolist() + [len(seen)]
        for bucket, (a, b) in enumerate(zip(edges, edges[1:])):
            if b > a:
                none = [pa.nulls(1, pa.int64())] * 6
                packed = squeeze(deltas(seen[a:b]), count[a:b].astype(np.uint32))
                yield pa.RecordBatch.from_arrays([*none, pa.array([bucket], pa.int32()), pa.array([b - a], pa.int32()), pa.array([packed], pa.binary())], names)
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, FEATURES)


def frequent_tokens(seen: DataFrame, least: float) -> np.ndarray:
    """Sorted tokens whose counts over all partitions reach `least`: at most (tokens / least) of them."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unsqueeze(d, n, np.uint64, np.uint32) for n, d in zip(table.column("many").to_pylist(), table.column("packed").to_pylist())]
        tok, at = np.unique(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), return_inverse=True)
        tok = tok[np.bincount(at, weights=np.concatenate([p[1] for p in parts])) >= least]
        return pa.table({"tokens": pa.array([tok.tobytes()], pa.binary())})

    rows = seen.where(F.col("bucket").isNotNull()).select("bucket", "many", "packed").groupBy("bucket").applyInArrow(run, "tokens binary")
    return np.sort(np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(r["tokens"], np.uint64) for r in rows.collect())]))


def _ordered_prefix(tok: np.ndarray, own: np.ndarray, n: int, hot: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, text, is frequent) of the first tokens of each text, rare first and then by hash."""
    late = np.zeros(len(tok), bool)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, tok), len(hot) - 1)
        late = hot[at] == tok
    order = np.argsort(own * 2 + late, kind="stable")  # tokens are sorted within a text
    tok, own, late = tok[order], own[order], late[order]
    size, first = _per_text(tok, own, n)
    keep = np.arange(len(tok)) - first[own] < rule.prefix(size)[own]
    return tok[keep], own[keep], late[keep]


def surviving_classes(docs: DataFrame, hot, rule: Rule) -> DataFrame:
    """(s1) of classes that share enough prefix tokens with others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = HashMemo()
        for part in chunks(batches, "text"):
            n = part.num_rows
            tok, own = token_sets(texts_of(part.column("text")), rule.width, memo)
            size, first = _per_text(tok, own, n)
            s1 = _reduce(np.add, scramble(tok, 0x11), first, size)
            tok, own, late = _ordered_prefix(tok, own, n, hot.value, rule)
            many = np.bincount(own[late], minlength=n)
            needed = rule.needed(size)
            # A row for each rare token.  Frequent ones are known to be shared; a text that has enough of them
            # survives at once, which a row of its own with nothing needed says.
            sent, done = ~late, np.flatnonzero((many >= needed) & (size > 0))
            row = part.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            own_token = scramble(s1 ^ scramble(row, 0x77), 0x78)[done]
            yield pa.RecordBatch.from_arrays(
                [
                    _signed(np.concatenate([tok[sent], own_token])),
                    _signed(np.concatenate([s1[own[sent]], s1[done]])),
                    pa.array(np.concatenate([np.maximum(needed - many, 1)[own[sent]], np.zeros(len(done))]).astype(np.int32)),
                ],
                ["token", "s1", "needed"],
            )
        give_back()

    rows = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).mapInArrow(run, "token long, s1 long, needed int")
    together = Window.partitionBy("token")
    rows = rows.withColumn("_lo", F.min("s1").over(together)).withColumn("_hi", F.max("s1").over(together)).withColumn("_before", F.lag("s1").over(together.orderBy("s1")))
    shared = rows.where((F.col("needed") == 0) | ((F.col("_lo") != F.col("_hi")) & F.coalesce(F.col("_before") != F.col("s1"), F.lit(True))))
    counted = shared.groupBy("s1").agg(F.count("*").alias("c"), F.min("needed").alias("least"), F.max("needed").alias("needed"))
    return counted.where((F.col("least") == 0) | (F.col("c") >= F.col("needed"))).select("s1")


class Sets:
    """Token sets of some documents as one numbered matrix in compressed rows."""

    def __init__(self, ids: np.ndarray, blobs: list[bytes]) -> None:
        self.ids = ids
        sets = [np.frombuffer(b, np.uint64) for b in blobs]
        self.size = np.array([len(s) for s in sets], np.int64)
        tok = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        self.union, number = np.unique(tok, return_inverse=True)
        self.own = np.repeat(np.arange(len(sets)), self.size)
        self.first = np.cumsum(self.size) - self.size
        self.number = number
        order = np.argsort(number, kind="stable")
        self.posting = self.own[order]
        self.start = np.searchsorted(number[order], np.arange(len(self.union) + 1))

    def overlaps(self, numbers: np.ndarray) -> np.ndarray:
        """Common tokens of every document with a set given by its token numbers."""
        a, b = self.start[numbers], self.start[numbers + 1]
        wide = b - a
        if not wide.sum():
            return np.zeros(len(self.size), np.int64)
        at = np.repeat(a - np.cumsum(wide) + wide, wide) + np.arange(int(wide.sum()))
        return np.bincount(self.posting[at], minlength=len(self.size))

    def row(self, i: int) -> np.ndarray:
        return self.number[self.first[i] : self.first[i] + self.size[i]]


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def link_chunk(sets: Sets, rule: Rule) -> list[tuple[int, int]]:
    """(id, id of the component's first) for the members of a chunk that are linked with another."""
    n = len(sets.ids)
    parent, done = np.arange(n), np.zeros(n, bool)

    def process(i: int) -> None:
        both = sets.overlaps(sets.row(i))
        for j in np.flatnonzero((both > 0) & rule.linked(both, sets.size[i], sets.size)):
            a, b = _find(parent, i), _find(parent, int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
        done[i] = True

    if n > 1:
        common = np.diff(sets.start)[sets.number]
        central = np.bincount(sets.own, weights=common, minlength=n) / np.maximum(sets.size, 1)
        process(0)  # the pivot, which all chunks of a key share
        if not done[int(central.argmax())]:
            process(int(central.argmax()))
        root = np.array([_find(parent, i) for i in range(n)])
        largest = np.bincount(root).argmax()
        for i in np.flatnonzero(root != largest):
            process(int(i))
    root = np.array([_find(parent, i) for i in range(n)], np.int64)
    return [(int(sets.ids[i]), int(sets.ids[root[i]])) for i in range(n) if root[i] != i]


LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _links(rows: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"u": pa.array([r[0] for r in rows], pa.int64()), "v": pa.array([r[1] for r in rows], pa.int64())})


def _load(table: pa.Table) -> Sets:
    return Sets(table.column("doc_id").to_numpy(), table.column("set").to_pylist())


def counted(rows: DataFrame, by: list[str], least: int) -> DataFrame:
    """rows (d, n, and by) of groups of `least` rows or more, with many, mass and pivot: the group's rows, sum of n and least d.

    Groups are counted and told by salted keys: a group's rows meet in SALTS places, not in one.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("d", F.lit(7)), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(*by, "_salt").agg(F.count("*").alias("_rows"), F.sum("n").alias("_sum"), F.min("d").alias("_low"))
    whole = parts.groupBy(*[F.col(k).alias(f"_{k}") for k in by]).agg(F.sum("_rows").alias("many"), F.sum("_sum").alias("mass"), F.min("_low").alias("pivot"), F.collect_list("_salt").alias("_salts"))
    told = whole.where(F.col("many") >= least).withColumn("_told", F.explode("_salts")).drop("_salts")
    same = F.col("_salt") == F.col("_told")
    for k in by:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return salted.join(told, same).select(*rows.columns, "many", "mass", "pivot")


def chunks_of(rows, mass, per: int):
    """How many chunks a group of that many rows and tokens is cut into."""
    return F.greatest(F.ceil(rows / per), F.ceil(mass / CHUNK_TOKENS)).cast("int")


def key_groups(sets: DataFrame, keys: tuple[str, ...], chunk: int) -> DataFrame:
    """d, w (which key), k, pivot, parts, part of the sets that share a min-hash key with others."""
    every = F.array(*[F.struct(F.lit(i).alias("w"), F.col(k).alias("k")) for i, k in enumerate(keys)])
    rows = sets.select(F.col("doc_id").alias("d"), "n", F.explode(every).alias("_k")).select("d", "n", F.col("_k.w").alias("w"), F.col("_k.k").alias("k"))
    dealt = counted(rows, ["w", "k"], 2).withColumn("parts", chunks_of(F.col("many"), F.col("mass"), chunk))
    return dealt.select("d", "w", "k", "pivot", "parts", F.pmod(F.xxhash64("d"), F.col("parts")).cast("int").alias("part"))


def group_links(sets: DataFrame, rule: Rule, chunk: int = CHUNK) -> DataFrame:
    """Links found within the groups of either min-hash key."""
    own = F.when(F.col("d") == F.col("pivot"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))
    dealt = key_groups(sets, ("k1", "k2"), chunk).select("d", "w", "k", "pivot", F.explode(own).alias("part"))
    rows = sets.select("doc_id", "set").join(dealt, F.col("doc_id") == F.col("d")).select("doc_id", "set", "w", "k", "pivot", "part")

    def run(table: pa.Table) -> pa.Table:
        pivot = table.column("pivot")[0].as_py()
        ids = table.column("doc_id").to_numpy()
        order = np.lexsort((ids, ids != pivot))
        links = _links(link_chunk(_load(table.take(pa.array(order))), rule))
        give_back()
        return links

    return rows.groupBy("w", "k", "part").applyInArrow(run, "u long, v long")


def matrix_links(sets: DataFrame, comp: DataFrame, hot, rule: Rule, chunk: int = CHUNK, queries: int = QUERIES) -> DataFrame:
    """Links between documents of different groups (comp: node, component), by the token-group matrix."""
    home = key_groups(sets, ("k1",), chunk).select(F.col("d").alias("_h"), (-1 - F.shiftrightunsigned(F.xxhash64("k", "part"), 1)).alias("_home"))
    named = comp.select(F.col("node").alias("_n"), "component")
    placed = sets.select(F.col("doc_id").alias("d"), "n").join(home, F.col("d") == F.col("_h"), "left").join(named, F.col("d") == F.col("_n"), "left")
    # A group that is a component counts its rows and tokens; any other is searched member by member (many is 1).
    linked = counted(placed.where(F.col("component").isNotNull()).select("d", "n", F.col("component").alias("g")), ["g"], 1)
    linked = linked.select("d", "n", "g", "many", chunks_of(F.col("many"), F.col("mass"), chunk).alias("parts"))
    loose = placed.where(F.col("component").isNull()).select("d", "n", F.coalesce("_home", "d").alias("g"), F.lit(1).cast("long").alias("many"), F.lit(1).alias("parts"))
    grouped = checkpointed(sets.select("doc_id", "set").join(linked.union(loose), F.col("doc_id") == F.col("d")).select("doc_id", "set", "n", "g", "many", "parts"))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            sets_ = [np.frombuffer(b, np.uint64) for b in part.column("set").to_pylist()]
            size = np.array([len(s) for s in sets_], np.int64)
            tok = np.concatenate(sets_) if sets_ else np.empty(0, np.uint64)
            tok, own, _ = _ordered_prefix(tok, np.repeat(np.arange(len(sets_)), size), len(sets_), hot.value, rule)
            take = pa.array(own)
            need = pa.array(rule.needed(size).astype(np.int32)).take(take)
            more = [part.column(c).take(take) for c in ("doc_id", "g", "many", "parts")]
            yield pa.RecordBatch.from_arrays([_signed(tok), *more, need], ["token", "doc_id", "g", "many", "parts", "needed"])

    rows = grouped.select("doc_id", "set", "g", "many", "parts").mapInArrow(prefixes, "token long, doc_id long, g long, many long, parts int, needed int")
    split = rows.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where(F.col("lo") != F.col("hi")).select(F.col("token").alias("t"))
    rows = checkpointed(rows.join(split, F.col("token") == F.col("t"), "left_semi"))
    unions = rows.select(F.col("token").alias("t"), F.col("g").alias("og"), F.col("many").alias("omany"), F.col("parts").alias("oparts")).distinct()
    asks = (F.col("many") < F.col("omany")) | ((F.col("many") == F.col("omany")) & (F.col("g") > F.col("og")))
    bound = rows.join(unions, (F.col("token") == F.col("t")) & asks).groupBy("doc_id", "og", "omany", "oparts").agg(F.count("*").alias("c"), F.max("needed").alias("needed"))
    opened = bound.where(F.col("c") >= F.col("needed")).select(F.col("doc_id").alias("q"), "og", "omany", "oparts")
    opened = checkpointed(opened.join(grouped.select("doc_id", "n"), F.col("q") == F.col("doc_id")).select("q", "n", "og", "omany", "oparts"))
    # The queries of a group are counted by salted keys too, and dealt to slices.
    sized = counted(opened.select(F.col("q").alias("d"), "n", F.col("og").alias("g"), F.col("oparts").alias("p"), (F.col("omany") == 1).alias("loose")), ["g", "p"], 1)
    sized = checkpointed(sized.withColumn("slices", chunks_of(F.col("many"), F.col("mass"), queries)).select(F.col("d").alias("q"), "g", "p", "loose", "slices"))
    ask = sized.withColumn("slice", F.pmod(F.xxhash64("q", F.lit(1)), F.col("slices")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    ask = ask.select("q", F.col("g").alias("og"), "slice", "part", "loose").join(grouped.select("doc_id", "set"), F.col("q") == F.col("doc_id")).select("og", "slice", "part", "doc_id", "set", "loose")
    asked = sized.select(F.col("g").alias("_og"), F.col("p").alias("_p"), "slices").distinct()
    held = asked.select("_og", "slices", F.explode(F.sequence(F.lit(0), F.col("_p") - 1)).alias("_part"))
    # A home's members are few (a chunk of a key at most); a component's are dealt to its parts.
    members = grouped.select("g", "doc_id", "set", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("parts")).cast("int").alias("part"))
    members = members.join(held, (F.col("g") == F.col("_og")) & (F.col("part") == F.col("_part"))).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    members = members.select(F.col("g").alias("og"), "slice", "part", "doc_id", "set")
    members = members.toDF(*members.columns)  # attributes of its own, as both sides come from grouped

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _links([])
        sets_, out, loose = _load(right), [], left.column("loose")[0].as_py()
        for q, blob in zip(left.column("doc_id").to_pylist(), left.column("set").to_pylist()):
            tok = np.frombuffer(blob, np.uint64)
            at = np.minimum(np.searchsorted(sets_.union, tok), len(sets_.union) - 1)
            at = at[sets_.union[at] == tok]
            if rule.den * len(at) < rule.num * len(tok):  # the bound over the whole union
                continue
            both = sets_.overlaps(at)
            hit = np.flatnonzero((both > 0) & rule.linked(both, len(tok), sets_.size))
            # Members that are one component already: one link says all.
            out += [(q, int(j)) for j in (sets_.ids[hit] if loose else sets_.ids[hit[:1]])]
        del sets_
        give_back()
        return _links(out)

    return ask.groupBy("og", "slice", "part").cogroup(members.groupBy("og", "slice", "part")).applyInArrow(run, "u long, v long")


def join(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100, chunk: int = CHUNK, hot_share: float = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    rule, sc = Rule(width, num, den), docs.sparkSession.sparkContext
    seen = checkpointed(features(docs, rule))
    rows = seen.where(F.col("bucket").isNull()).select("doc_id", "n", "s1", "s2", "k1", "k2")
    hot = sc.broadcast(frequent_tokens(seen, max(8.0, hot_share * rows.count())))  # bounded by 1 / hot_share
    classes = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("k1").alias("k1"), F.first("k2").alias("k2"))
    alive = surviving_classes(docs, hot, rule).withColumnRenamed("s1", "_s1")
    chosen = checkpointed(classes.join(alive, F.col("s1") == F.col("_s1"), "left_semi").select("rep", "n", "k1", "k2", "s1", "s2"))
    sets = checkpointed(_sets_of(docs, chosen, rule))
    comp = components(group_links(sets, rule, chunk))
    comp = checkpointed(comp)
    more = components(matrix_links(sets, comp, hot, rule, chunk).union(comp.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    more = more.withColumnRenamed("node", "_node")
    named = classes.select("s1", "s2", "rep").join(more, F.col("rep") == F.col("_node"), "left").select(F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), F.coalesce("component", "rep").alias("_c"))
    out = rows.join(named, (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id")).alias("component_id"))


def representatives(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs (doc_id, text, ...) that stay when one document of each component does: the one with the smallest id.

    A document is an id with a text: where an id repeats with different texts, or is null, each of
    its texts is a document of its own (null is the largest id; then the smaller digest of the text
    stays).  Of rows equal in id and text one stays, the first by its other columns as JSON.
    """
    digest, row, key, i, d, k = unused(docs.columns, "_digest", "_row", "_key", "_id", "_text", "_new")
    marked = docs.withColumn(digest, F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    texts = checkpointed(marked.select(F.col("doc_id").alias(i), F.col(digest).alias(d)).distinct())
    several = texts.groupBy(F.col(i).alias("s")).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col("s").isNull())
    odd = texts.join(several, F.col(i).eqNullSafe(F.col("s"))).select(i, d)
    low = texts.agg(F.min(i)).first()[0] or 0
    odd = checkpointed(odd.withColumn(k, F.lit(min(low, 0) - 1) - F.monotonically_increasing_id()))  # numbers that are no ids
    if odd.limit(1).count():
        keyed = marked.join(odd, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(digest) == F.col(d)), "left")
        keyed = keyed.withColumn(row, F.coalesce(k, "doc_id")).drop(i, d, k, digest)
        found = join(keyed.select(F.col(row).alias("doc_id"), "text"), width, num, den).select(F.col("doc_id").alias("r"), "component_id").distinct()
        found = found.join(odd, F.col("r") == F.col(k), "left")
        real = F.when(F.col(k).isNull(), F.col("r")).otherwise(F.col(i))
        order = F.struct(real.isNull(), real, F.coalesce(d, F.lit("")), "r")
        stay = found.groupBy("component_id").agg(F.min_by("r", order).alias(key)).select(key)
    else:
        keyed = marked.withColumn(row, F.col("doc_id")).drop(digest)
        found = join(keyed.select("doc_id", "text"), width, num, den)
        stay = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(key)).distinct()
    kept = keyed.join(stay, F.col(row) == F.col(key)).drop(key)
    others = F.to_json(F.struct(*[c for c in docs.columns if c != "text"]))
    first = kept.groupBy(row).agg(F.min_by(F.struct(*docs.columns), others).alias(key))
    return first.select(f"{key}.*")


def _sets_of(docs: DataFrame, chosen: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n, k1, k2, set of the representatives in chosen."""
    sc = docs.sparkSession.sparkContext
    bits, wanted = 1 << 16, min(FILTER_BITS, 16 * chosen.count())
    while bits < wanted:
        bits *= 2
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits)).cast("int")

    # A bitmap of fixed size at most: it spares sets that the join would drop, and decides nothing.
    def pack(table: pa.Table) -> pa.Table:
        part = np.zeros(4096, bool)
        part[table.column("s").to_numpy() & 4095] = True
        return pa.table({"b": pa.array([table.column("b")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(part).tobytes()], pa.binary())})

    mask = np.zeros(bits // 8, np.uint8)
    marked = chosen.select(slot("rep").alias("s")).withColumn("b", F.shiftright("s", 12))
    for r in marked.groupBy("b").applyInArrow(pack, "b int, bits binary").collect():  # `bits` bits in all
        mask[r["b"] * 512 : (r["b"] + 1) * 512] = np.frombuffer(r["bits"], np.uint8)
    shared = sc.broadcast(mask)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, bitmap = HashMemo(), shared.value
        for batch in batches:
            at = batch.column("_slot").to_numpy()
            batch = batch.filter(pa.array((bitmap[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))
            for part in chunks(iter([batch]), "text"):
                n = part.num_rows
                tok, own = token_sets(texts_of(part.column("text")), rule.width, memo)
                size, first = _per_text(tok, own, n)
                sums = [_reduce(np.add, scramble(tok, c), first, size) for c in (0x11, 0x22)]
                sets = [tok[a : a + k].tobytes() for a, k in zip(first, size)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *map(_signed, sums), pa.array(sets, pa.binary())], ["doc_id", "t1", "t2", "set"])

    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", slot("doc_id").alias("_slot")).mapInArrow(run, "doc_id long, t1 long, t2 long, set binary")
    rows = rows.join(chosen, (F.col("doc_id") == F.col("rep")) & (F.col("t1") == F.col("s1")) & (F.col("t2") == F.col("s2")))
    return rows.select("doc_id", "n", "k1", "k2", "set")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: md5(array_to_string(w[i:i + 3], ' '))))
                          WHEN len(w) > 0 THEN [md5(array_to_string(w, ' '))] ELSE [] END AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS k FROM g),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common, any_value(a.n) + any_value(b.n) AS total FROM e a JOIN e b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p WHERE 100 * common >= 85 * (total - common)),
u AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, u.y FROM r JOIN u ON r.m = u.x),
c AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id)
SELECT g.doc_id, len(g)::BIGINT AS n_shingles, component_id FROM g JOIN c ON g.doc_id = c.doc_id
"""
