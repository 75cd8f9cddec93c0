"""Long repeated spans by compacting a de Bruijn graph of words.

Edges are the windows (k-mers) of `span` consecutive words, nodes the runs of span - 1 words between two
of them. Edges that follow each other without a branch compact into one path:

1. Within a document, consecutive windows that share their minimizer (the least hash among their K-word
   runs) make one local path. Equal windows have equal minimizers, so only paths whose minimizer stands
   in two places can repeat; most of the graph ends here, without a row per window.
2. A minimizer all of whose local paths are equal doesn't branch: the path is compact as it is.
3. At minimizers with several different local paths the graph branches. These paths, once each, become
   a table of edges with what comes before and after them. Edges of one document only are dropped; two
   edges are linked where the first is all that comes before the second and the second all that follows
   the first (in- and out-degree 1), and the links compact by pointer jumping: joins of the link table
   with itself, each of which doubles the distance to the head of the path.

Paths carry source coordinates: smallest document, and first word in it. Paths of a document on one
diagonal (position here less position in the source) merge into spans, and the words of each span are
compared with the words at its source coordinates before any is removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointmill.llm.common import BASES, INVERSES, WordHashes, discard, join_skewed, map_arrow, mix, powers, signed, staged

#: Words of the runs that minimizers are taken of, and of the blocks in which a source gives its words.
K, BLOCK = 13, 64


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


class Rolling:
    """Two hashes of any run of words, from prefix sums modulo 2**64."""

    def __init__(self, words: list[bytes], hashes: tuple[WordHashes, WordHashes]):
        self.n = len(words)
        first = hashes[0].of(words)
        self.sums, self.back = [], []
        for h, base, inverse in zip((first, mix(first ^ np.uint64(0x5BD1E995))), BASES, INVERSES):
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(base, self.n), dtype=np.uint64)]))
            self.back.append(powers(inverse, self.n + 1))

    def of(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(mix((s[stop] - s[start]) * b[start] + (stop - start).astype(np.uint64)) for s, b in zip(self.sums, self.back))

    def one(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[0][stop] - self.sums[0][start]) * self.back[0][start])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def local_paths(roll: Rolling, span: int, longest: int = 256):
    """(minimizer, first window, windows) of the paths of one document; none if it has no window."""
    n = roll.n - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = min(K, span)
    at = np.arange(roll.n - k + 1)
    least = sliding_min(roll.one(at, at + k), span - k + 1)
    starts = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    counts = np.diff(np.r_[starts, n])
    if counts.max() > longest:  # of words that repeat endlessly
        pieces = -(-counts // longest)
        inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, left = np.repeat(starts, pieces) + inner * longest, np.repeat(counts, pieces) - inner * longest
        counts = np.minimum(left, longest)
    return least[starts], starts, counts


class _Box:
    """Hashes of words that a worker keeps from batch to batch."""

    def __init__(self):
        self.hashes = None

    def __call__(self) -> tuple[WordHashes, WordHashes]:
        if self.hashes is None:
            h = WordHashes()
            self.hashes = h, h
        return self.hashes


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, mark, text): rows that agree in doc and mark are equal, and all that happens to one happens to the other."""
    t = F.col(f"`{text}`")
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.xxhash64(t).alias("mark"), t.alias("text"))


def paths(rows: DataFrame, span: int) -> DataFrame:
    """(m, p1, p2, doc, mark, start, n): every local path, by its minimizer and its identity."""
    box = _Box()

    def run(batch: pa.RecordBatch):
        m, p1, p2, doc, mark, at, n = [], [], [], [], [], [], []
        for d, k, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
            words = words_of(t)
            if len(words) < span or d is None:
                continue
            roll = Rolling(words, box())
            least, starts, counts = local_paths(roll, span)
            a, b = roll.of(starts, starts + counts + span - 1)
            m.append(least), p1.append(a), p2.append(b), at.append(starts), n.append(counts)
            doc.append(np.full(len(starts), d, np.int64)), mark.append(np.full(len(starts), k, np.int64))
        if m:
            whole = [signed(np.concatenate(x)) for x in (m, p1, p2)] + [pa.array(np.concatenate(x)) for x in (doc, mark)]
            whole += [pa.array(np.concatenate(x).astype(np.int32)) for x in (at, n)]
            yield pa.RecordBatch.from_arrays(whole, names=["m", "p1", "p2", "doc", "mark", "start", "n"])

    return map_arrow(rows, run, "m long, p1 long, p2 long, doc long, mark long, start int, n int")


def _windows(rows: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """(p1, p2, doc, start, mark, last, w1, w2): the wanted local paths (p1, p2, doc, mark, start, n, last), with the identities of their windows in order."""
    box = _Box()
    by_doc = wanted.groupBy("doc", "mark").agg(F.collect_list(F.struct("p1", "p2", "start", "n", "last")).alias("paths"))

    def run(batch: pa.RecordBatch):
        out, held = [], 0
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        names = ["p1", "p2", "doc", "mark", "start", "last", "w1", "w2"]
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names)
        for doc, mark, t, want in zip(*(batch.column(c).to_pylist() for c in ("doc", "mark", "text", "paths"))):
            roll = Rolling(words_of(t), box())
            for p in want:
                at = np.arange(p["start"], p["start"] + p["n"])
                w1, w2 = roll.of(at, at + span)
                out.append((p["p1"], p["p2"], doc, mark, p["start"], p["last"], w1.view(np.int64), w2.view(np.int64)))
                held += p["n"]
                if held > 100_000:
                    yield pack()
                    out, held = [], 0
        if out:
            yield pack()

    kept = rows.join(by_doc, ["doc", "mark"]).select("doc", "mark", "text", "paths")
    return map_arrow(kept, run, "p1 long, p2 long, doc long, mark long, start int, last long, w1 array<long>, w2 array<long>")


def edges(windows: DataFrame) -> DataFrame:
    """(w1, w2, source, held, prev1, prev2, next1, next2): the edges that stand in two documents or more, and how often.

    prev and next are the only edge before and after it, null where there are several or where a local
    path begins or ends there; source is the smallest document."""
    e = windows.select("doc", "last", F.size("w1").alias("n"), "w1", "w2", F.posexplode(F.arrays_zip(F.col("w1").alias("x"), F.col("w2").alias("y"))).alias("i", "e"))
    beside = lambda c, step: F.try_element_at(c, F.col("i") + F.lit(1 + step))
    first, final = F.col("i") == 0, F.col("i") == F.col("n") - 1
    e = e.select(
        F.col("e.x").alias("w1"), F.col("e.y").alias("w2"), "doc", "last",
        *[F.when(~first, beside(F.col(w), F.when(first, 0).otherwise(-1))).alias(f"b{w}") for w in ("w1", "w2")],
        *[F.when(~final, beside(F.col(w), 1)).alias(f"a{w}") for w in ("w1", "w2")],
    )
    beyond = [f(c).alias(f"{k}_{c}") for c in ("bw1", "bw2", "aw1", "aw2") for k, f in (("lo", F.min), ("hi", F.max), ("n", F.count))]
    g = e.groupBy("w1", "w2").agg(F.min("doc").alias("source"), F.max("last").alias("last"), F.count(F.lit(1)).alias("n"), *beyond).where("source < last")

    def only(side: str):
        sure = " and ".join(f"lo_{side}{w} = hi_{side}{w} and n_{side}{w} = n" for w in ("w1", "w2"))
        return [F.when(F.expr(sure), F.col(f"lo_{side}{w}")) for w in ("w1", "w2")]

    (p1, p2), (n1, n2) = only("b"), only("a")
    return g.select("w1", "w2", "source", F.col("n").alias("held"), p1.alias("prev1"), p2.alias("prev2"), n1.alias("next1"), n2.alias("next2"))


def compact(graph: DataFrame) -> DataFrame:
    """(w1, w2, source, held, n): the heads of the nonbranching paths of a staged edge table, and their numbers of edges.

    Every local path begins with an edge that nothing is sure to come before, so no path is a ring."""
    before = graph.select(F.col("w1").alias("up1"), F.col("w2").alias("up2"), F.col("next1").alias("x1"), F.col("next2").alias("x2"))
    at = (F.col("prev1") == F.col("up1")) & (F.col("prev2") == F.col("up2")) & (F.col("x1") == F.col("w1")) & (F.col("x2") == F.col("w2"))
    links = staged(graph.join(before, at).select("w1", "w2", "up1", "up2", F.lit(1).alias("far"), F.lit(False).alias("moved")))
    while not links.isEmpty():
        to = links.select(F.col("w1").alias("up1"), F.col("w2").alias("up2"), F.col("up1").alias("t1"), F.col("up2").alias("t2"), F.col("far").alias("more"))
        jumped = links.join(to, ["up1", "up2"], "left").select(
            "w1", "w2", F.coalesce("t1", "up1").alias("up1"), F.coalesce("t2", "up2").alias("up2"),
            (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("more").isNotNull().alias("moved"),
        )
        last, links = links, staged(jumped)
        discard(last)
        if links.where("moved").isEmpty():
            break
    heads = graph.join(links, ["w1", "w2"], "left_anti").select("w1", "w2", "source", "held")
    longest = links.groupBy(F.col("up1").alias("w1"), F.col("up2").alias("w2")).agg(F.max("far").alias("far"))
    return heads.join(longest, ["w1", "w2"], "left").select("w1", "w2", "source", "held", (F.coalesce("far", F.lit(0)) + 1).alias("n"))


def repeated_paths(rows: DataFrame, span: int) -> DataFrame:
    """(doc, mark, start, n, sdoc, smark, sstart): runs of windows, and where they start in a smaller document."""
    every = staged(paths(rows, span))
    # a minimizer in one place only belongs to no repeat; most paths end here
    twice = staged(every.groupBy("m").agg(F.count(F.lit(1)).alias("places")).where("places > 1"))
    live = staged(join_skewed(every, twice, ["m"], "places", "left_semi"))
    discard(every, twice)
    at = F.min(F.struct("doc", "mark", "start", "n")).alias("at")
    distinct = live.groupBy("m", "p1", "p2").agg(at, F.max("doc").alias("last"), F.count(F.lit(1)).alias("held"))
    distinct = staged(distinct.select("m", "p1", "p2", "at.*", "last", "held"))
    ways = staged(distinct.groupBy("m").agg(F.count(F.lit(1)).alias("ways")).where("ways > 1"))
    windows = staged(_windows(rows, join_skewed(distinct, ways, ["m"], "ways", "left_semi"), span))
    graph = staged(edges(windows))
    heads = staged(compact(graph))
    place = windows.select("p1", "p2", "doc", "mark", "start", F.posexplode(F.arrays_zip(F.col("w1").alias("x"), F.col("w2").alias("y"))).alias("i", "e"))
    place = place.select("p1", "p2", "doc", "mark", "start", "i", F.col("e.x").alias("w1"), F.col("e.y").alias("w2"))
    # an edge of a passage that very many documents share stands in very many local paths
    place = staged(join_skewed(place, heads.withColumn("times", F.col("held")), ["w1", "w2"], "held"))
    origin = place.where("doc = source").groupBy("w1", "w2").agg(F.min(F.struct("mark", (F.col("start") + F.col("i")).alias("sstart"))).alias("o"), F.max("times").alias("held"))
    split = join_skewed(place, staged(origin), ["w1", "w2"], "held").groupBy("p1", "p2").agg(F.collect_set(F.struct("i", "n", F.col("source").alias("sdoc"), F.col("o.mark").alias("smark"), F.col("o.sstart").alias("sstart"))).alias("split"))
    own = F.struct(F.lit(0).alias("i"), "n", F.col("doc").alias("sdoc"), F.col("mark").alias("smark"), F.col("start").alias("sstart"))
    known = distinct.join(split, ["p1", "p2"], "left").where("doc < last or split is not null")
    known = staged(known.select("p1", "p2", "held", F.col("doc").alias("first"), own.alias("own"), "split"))
    # a path that a smaller document has whole comes from there; else its parts that smaller documents have
    met = join_skewed(live.select("p1", "p2", "doc", "mark", "start"), known, ["p1", "p2"], "held")
    parts = F.when(F.col("first") < F.col("doc"), F.array("own")).otherwise(F.filter("split", lambda s: s["sdoc"] < F.col("doc")))
    found = met.select("doc", "mark", F.col("start").alias("at"), F.explode(parts).alias("s"))
    out = staged(found.select("doc", "mark", (F.col("at") + F.col("s.i")).alias("start"), "s.n", "s.sdoc", "s.smark", "s.sstart"))
    discard(live, distinct, ways, windows, graph, heads, place, known)
    return out


def spans_of(runs: DataFrame, span: int) -> DataFrame:
    """(doc, mark, start, stop, shift, sdoc, smark): runs on one diagonal that meet or overlap, as spans of words."""
    diagonal = ["doc", "mark", "sdoc", "smark", "shift"]
    d = runs.select("doc", "mark", "sdoc", "smark", (F.col("start") - F.col("sstart")).alias("shift"), "start", (F.col("start") + F.col("n")).alias("end"))
    order = Window.partitionBy(*diagonal).orderBy("start")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("new", F.when(reached.isNull() | (F.col("start") > reached), 1).otherwise(0))
    d = d.withColumn("no", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.groupBy(*diagonal, "no").agg(F.min("start").alias("start"), (F.max("end") + F.lit(span - 1)).alias("stop"))
    return d.select("doc", "mark", "start", "stop", "shift", "sdoc", "smark")


def with_source_words(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc, mark, start, stop, shift, block, words): spans, a row per block of BLOCK words of their source, with these words.

    A source gives each of its blocks once, however many copies it has."""
    block = lambda at: F.floor((F.col(at) - F.col("shift") - F.lit(int(at == "stop"))) / BLOCK).cast("int")
    asked = staged(spans.withColumn("block", F.explode(F.sequence(block("start"), block("stop")))))
    wanted = asked.groupBy("sdoc", "smark", "block").agg(F.count(F.lit(1)).alias("held"))
    wanted = wanted.groupBy(F.col("sdoc").alias("doc"), F.col("smark").alias("mark")).agg(F.collect_list(F.struct("block", "held")).alias("blocks"))

    def run(batch: pa.RecordBatch):
        out = []
        for doc, mark, t, blocks in zip(*(batch.column(i).to_pylist() for i in range(4))):
            words = words_of(t)
            out += [(doc, mark, b["block"], b["held"], b" ".join(words[b["block"] * BLOCK : (b["block"] + 1) * BLOCK])) for b in blocks]
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=["sdoc", "smark", "block", "held", "words"])

    given = map_arrow(rows.join(wanted, ["doc", "mark"]).select("doc", "mark", "text", "blocks"), run, "sdoc long, smark long, block int, held long, words binary")
    given = staged(given.groupBy("sdoc", "smark", "block").agg(F.max("held").alias("held"), F.max("words").alias("words")))  # equal rows give equal blocks
    out = staged(join_skewed(asked, given, ["sdoc", "smark", "block"], "held").select("doc", "mark", "start", "stop", "shift", "block", "words"))
    discard(asked, given)
    return out


def same_words(words: list[bytes], s: dict) -> bool:
    """Whether the words of a span are those of the source's block, as far as the block reaches."""
    source, first = s["words"].split(b" "), s["block"] * BLOCK
    a, b = max(s["start"] - s["shift"], first), min(s["stop"] - s["shift"], first + BLOCK)
    return words[a + s["shift"] : b + s["shift"]] == source[a - first : b - first]


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<start:int,stop:int>>"


def remove_repeats(docs: DataFrame, span: int = 50, key: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """Per row: words, words removed, SHA-256 of the kept words, the kept words, the removed spans.

    A word goes if a window of `span` words that covers it also starts in a row of smaller doc_id;
    windows are judged on the input. A span whose words are not those at its source coordinates, which
    takes a collision of 128-bit hashes, stays. Null and empty texts have no words; texts of any length
    are read whole. Rows with a null doc_id neither lose words nor are a source. Rows that repeat a
    doc_id are no source to each other; each is judged by its own text, and equal rows alike. Columns of
    any other name are left out. An empty table gives no rows.
    """
    rows = _rows(docs, key, text)
    runs = repeated_paths(rows, span)
    known = with_source_words(rows, spans_of(runs, span))
    discard(runs)
    lost = known.groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "stop", "shift", "block", "words")).alias("parts"))
    d = rows.join(lost, ["doc", "mark"], "left").select("doc", "text", "parts")

    def run(batch: pa.RecordBatch):
        out: list[tuple] = []
        for doc, t, parts in zip(*(batch.column(i).to_pylist() for i in range(3))):
            words = words_of(t)
            other = {(s["start"], s["stop"], s["shift"]) for s in parts or () if not same_words(words, s)}
            gone = np.zeros(len(words) + 1, np.int64)
            for a, b in {(s["start"], s["stop"]) for s in parts or () if (s["start"], s["stop"], s["shift"]) not in other}:
                gone[a] += 1
                gone[b] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            kept = b" ".join(w for w, g in zip(words, gone) if not g) if gone.any() else b" ".join(words)
            ends = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
            cut = [{"start": int(a), "stop": int(b)} for a, b in zip(ends[::2], ends[1::2])]
            out.append((doc, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None, cut))
        cols = list(zip(*out)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans"])

    return map_arrow(d, run, RESULT)
