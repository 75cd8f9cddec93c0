"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import base64
import random
import zlib
from array import array
from bisect import bisect_left, insort
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.llm.common import map_arrow, ship, staged

END_OF_TEXT = "<|endoftext|>"
#: Characters beyond which ids are not made as a list, which takes several times their memory.
LONG = 1 << 20

#: The split pattern of GPT-2, and one that splits alike with less backtracking: spaces at the end are one match
#: either way, and where the lookahead fails a single space is left.
GPT2 = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
POSSESSIVE = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


class Encoder:
    """ids of byte_bpe_50k: the rank file of the same vocabulary is several times faster and gives equal
    ids; texts that spell a special token go through the tokenizers library itself, loaded when one comes."""

    def __init__(self, json_path: str, rank_path: str | None, pattern: str | None):
        self.json_path, self.fast = json_path, None
        if rank_path:
            import tiktoken

            with open(rank_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            pattern = POSSESSIVE if pattern == GPT2 else pattern
            self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def exact(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or END_OF_TEXT in text:
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        if len(text) > LONG:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        # cheaper than encode_to_numpy, which also looks for special tokens
        return np.frombuffer(array("I", self.fast.encode_ordinary(text)), dtype=np.uintc).astype("<u4", copy=False)


@lru_cache(maxsize=2)
def encoder(json_path: str, rank_path: str | None, pattern: str | None) -> Encoder:
    """A worker's encoder, which its next tasks use again."""
    return Encoder(json_path, rank_path, pattern)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = 2048, tokenizer: tuple | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of each document: ids of its text (null: none), then id 0, cut if longer than capacity.

    Of a cut document the first piece is the short one, all others are full. Rows with equal or null keys
    are separate documents. Texts of any length are read whole. Columns of any other name are left out.
    An empty table gives no pieces.
    """
    if tokenizer is None:
        import public_tokenizers as public

        tokenizer = (public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)

    def cut(batch: pa.RecordBatch):
        encode = encoder(*tokenizer)
        out: list[tuple] = []
        for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.append(encode(t or ""), np.uint32(0)).astype("<u4", copy=False)
            at, n, no = 0, len(ids), 0
            while at < n:
                step = (n - at) % capacity or capacity
                out.append((doc, no, at, step, zlib.crc32(ids[at : at + step].tobytes())))
                at, no = at + step, no + 1
        cols = list(zip(*out)) or [[]] * 5
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), cut, PIECES)


# A packing is a list of bins; a bin is (fill, [item, ...]); items are indexes of `size`.


def best_fit(bins: list, items: list[int], size: list[int], capacity: int) -> list:
    """Put items, largest first, each into the fullest bin that still holds it, else into a new one."""
    items = sorted(items, key=lambda i: (-size[i], i))
    least, out = size[items[-1]] if items else capacity + 1, list(bins)
    room = sorted((capacity - fill, n) for n, (fill, _) in enumerate(bins) if capacity - fill >= least)
    for _, n in room:
        out[n] = (out[n][0], list(out[n][1]))
    for i in items:
        at = bisect_left(room, (size[i], -1))
        if at < len(room):
            left, n = room.pop(at)
            fill, held = out[n]
            held.append(i)
            out[n] = (fill + size[i], held)
        else:
            left, n = capacity, len(out)
            out.append((size[i], [i]))
        if left - size[i] >= max(least, 1):
            insort(room, (left - size[i], n))
    return out


def fitness(bins: list, capacity: int) -> tuple:
    """Fewer bins first; of as many, the packing whose fills are the more unequal."""
    return (-len(bins), sum((fill / capacity) ** 2 for fill, _ in bins))


def replace(bins: list, loose: list[int], size: list[int], capacity: int) -> tuple[list, list[int]]:
    """Fill bins better by swapping one or two of their items for a larger loose one that still fits; what
    is swapped out becomes loose, so loose items only get smaller."""
    pool, out = sorted((size[i], i) for i in loose), []
    for fill, held in bins:
        room = capacity - fill
        if room and pool:
            few = held[:8]
            for old, gone in [(size[i], (i,)) for i in held] + [(size[i] + size[j], (i, j)) for n, i in enumerate(few) for j in few[:n]]:
                at = bisect_left(pool, (old + room + 1, -1)) - 1
                if at >= 0 and pool[at][0] > old:
                    new, item = pool.pop(at)
                    held = [i for i in held if i not in gone] + [item]
                    fill += new - old
                    for i in gone:
                        insort(pool, (size[i], i))
                    break
        out.append((fill, held))
    return out, [i for _, i in pool]


def _settle(bins: list, loose: list[int], size: list[int], capacity: int) -> list:
    bins, loose = replace(bins, loose, size, capacity)
    return best_fit(bins, loose, size, capacity)


def cross(a: list, b: list, size: list[int], capacity: int, rng: random.Random) -> list:
    """Inject a share of b's best filled bins whole into a, drop a's bins that hold any of their items,
    and best-fit what that displaces."""
    best = sorted(b, key=lambda x: -x[0])[: max(1, len(b) // 2)]
    injected = rng.sample(best, max(1, len(best) // 2))
    taken = {i for _, held in injected for i in held}
    kept, displaced = [], []
    for bin_ in a:
        if taken.isdisjoint(bin_[1]):
            kept.append(bin_)
        else:
            displaced.extend(i for i in bin_[1] if i not in taken)
    return _settle(injected + kept, displaced, size, capacity)


def mutate(a: list, size: list[int], capacity: int, rng: random.Random) -> list:
    """Empty some of the worst filled bins and a few others, and best-fit their items."""
    ranked = sorted(range(len(a)), key=lambda n: a[n][0])
    out = {*ranked[: max(1, len(a) // 20)], *rng.sample(ranked, min(len(a), 4))}
    return _settle([x for n, x in enumerate(a) if n not in out], [i for n in sorted(out) for i in a[n][1]], size, capacity)


def evolve(size: list[int], capacity: int, seed: int, migrants: list | None = None, population: int = 6, patience: int = 12) -> list:
    """The best packing of one island: its own population, into which migrants, elite packings of another
    island, come. Ends at the volume bound, which no packing can beat, or after `patience` generations
    in which the best packing did not get better."""
    rng = random.Random(seed)
    bound = -(-sum(size) // capacity)
    scored = lambda p: (fitness(p, capacity), p)
    score = lambda x: x[0]
    order = list(range(len(size)))
    pool = [scored(p) for p in (best_fit([], order, size, capacity), *(migrants or []))]
    while len(pool) < population and len(pool[0][1]) > bound:
        pool.append(scored(mutate(pool[rng.randrange(len(pool))][1], size, capacity, rng)))
    pool.sort(key=score, reverse=True)
    idle = 0
    while len(pool[0][1]) > bound and idle < patience:
        a, b = pool[rng.randrange(2)][1], pool[rng.randrange(1, len(pool))][1]
        child = scored(mutate(cross(a, b, size, capacity, rng), size, capacity, rng))
        idle = 0 if score(child) > score(pool[0]) else idle + 1
        pool[-1] = max(pool[-1], child, key=score)
        pool.sort(key=score, reverse=True)
    return pool[0][1]


PLACED = "no long, length long, district long, island int, bin long, offset long, fill long, bins long, bound long"


def _bins(t: pa.Table, column: str, size: list[int]) -> list | None:
    """The packing in a column of bin numbers, none where it is null."""
    if t.column(column).null_count:
        return None
    held: dict[int, list[int]] = {}
    for i, b in enumerate(t.column(column).to_pylist()):
        held.setdefault(b, []).append(i)
    return [(sum(size[i] for i in x), x) for x in held.values()]


def _island(capacity: int, patience: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("no", "ascending")])
        size = t.column("length").to_pylist()
        district, island = t.column("district")[0].as_py(), t.column("island")[0].as_py()
        come = [p for p in (_bins(t, c, size) for c in ("own", "migrant")) if p]
        bins = evolve(size, capacity, (district & 0xFFFF) * 64 + island + 7 * bool(come), come, patience=patience)
        n = len(size)
        bin_, offset, fill = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for b, (full, held) in enumerate(bins):
            at = 0
            for i in held:
                bin_[i], offset[i], fill[i] = b, at, full
                at += size[i]
        every = [pa.array(np.full(n, x)) for x in (len(bins), -(-sum(size) // capacity))]
        return pa.table([*[t.column(c) for c in ("no", "length", "district", "island")], pa.array(bin_), pa.array(offset), pa.array(fill), *every], names=[x.split()[0] for x in PLACED.split(", ")])

    return run


#: Islands that a task evolves, one after the other, where there are many, and the most tasks of an epoch,
#: beyond which a task gets more of them.
ISLANDS_A_TASK, MOST_TASKS = 4, 20_000


def _evolved(dealt: DataFrame, capacity: int, islands: int, epochs: int, patience: int, districts: int = 1) -> DataFrame:
    """(no, length, district, bin, offset, fill): the best packing of each district (no, length, district).

    A district's pieces are packed by `islands` populations apart. Between epochs the best packing of each
    island, its elite, goes to the next island of the district's ring, where crossover injects its best
    bins whole. Districts at their volume bound are done and go through no more epochs. An island is much
    work on few bytes, so the islands are dealt to tasks by number; by size they would share one."""
    tasks = min(max(2 * islands, districts * islands // ISLANDS_A_TASK), MOST_TASKS)
    none = [F.lit(None).cast("long").alias(c) for c in ("own", "migrant")]
    open_ = dealt.select("no", "length", "district", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), *none)
    done = []
    for epoch in range(epochs):
        placed = staged(open_.repartition(tasks, "district", "island").groupBy("district", "island").applyInArrow(_island(capacity, patience), PLACED))
        at = placed.groupBy("district").agg(F.min(F.struct("bins", "island")).alias("b"), F.min("bound").alias("bound"))
        at = staged(at.select(F.col("district").alias("at"), F.col("b.island").alias("best"), (F.col("b.bins") <= F.col("bound")).alias("done")))
        ends = F.lit(True) if epoch == epochs - 1 else F.col("done")
        done.append(placed.join(at, (F.col("district") == F.col("at")) & (F.col("island") == F.col("best"))).where(ends).select("no", "length", "district", "bin", "offset", "fill"))
        if epoch == epochs - 1 or at.where("not done").isEmpty():
            break
        left = placed.join(at.where("not done"), F.col("district") == F.col("at")).select("no", "length", "district", "island", "bin")
        own = left.withColumnRenamed("bin", "own")
        come = left.select("no", ((F.col("island") + 1) % islands).alias("island"), F.col("bin").alias("migrant"))
        open_ = own.join(come, ["no", "island"]).select("no", "length", "district", "island", "own", "migrant")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def pack(parts: DataFrame, capacity: int = 2048, district_rows: int = 4000, rounds: int = 2, keep: float = 1.0, islands: int = 3, epochs: int = 3, patience: int = 12) -> DataFrame:
    """parts with sequence_id and offset: gapless, no sequence over capacity.

    Full pieces are sequences of their own. The others are numbered and dealt by a hash of the number, so
    that equal rows part, to districts of about district_rows pieces, each evolved by islands (see
    _evolved). Between rounds sequences filled to at least `keep` settle; the pieces of all others are dealt
    to fewer districts, where they meet those of other ones. So at the end one sequence a district of
    the last round is badly filled, if any.
    """
    ship(parts.sparkSession)
    columns = parts.columns
    parts = staged(parts.withColumn("no", F.monotonically_increasing_id()))
    full = parts.where(F.col("length") >= capacity).withColumns({"sequence_id": F.lit(7 << 60) + F.col("no"), "offset": F.lit(0).cast("long")})
    rest, settled = parts.where(F.col("length") < capacity).select("no", "length"), []
    for turn in range(rounds + 1):
        n = rest.count()
        if not n:
            break
        districts = max(1, -(-n // district_rows))
        dealt = rest.withColumn("district", F.pmod(F.xxhash64(F.lit(turn), "no"), F.lit(districts)).cast("long"))
        placed = staged(_evolved(dealt, capacity, islands, epochs, patience, districts))
        placed = placed.withColumn("sequence_id", F.lit(turn << 60) + F.col("district") * F.lit(1 << 20) + F.col("bin"))
        last = turn == rounds or districts == 1
        settled.append((placed if last else placed.where(F.col("fill") >= keep * capacity)).select("no", "sequence_id", "offset"))
        if last:
            break
        rest = placed.where(F.col("fill") < keep * capacity).select("no", "length")
    out = full.select(*columns, "sequence_id", "offset")
    if not settled:
        return out
    places = settled[0]
    for x in settled[1:]:
        places = places.unionByName(x)
    return out.unionByName(parts.join(places, "no").select(*columns, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, capacity: int = 2048, **options) -> DataFrame:
    return pack(pieces(docs, capacity), capacity, **options)
