"""N-gram Jaccard join: prefix trees over globally ordered n-gram sets, verified and exact.

Every decision is lossless for links of Jaccard >= percent/100 between word shingle sets:

1. Equal sets form one class. A class counts as itself from here on.
2. Two linked sets share one of the first |x| - ceil(t|x|) + 1 n-grams of either, in any global order.
   Take an order that begins with the n-grams below a fixed hash bound that stand in one class only: a
   class with a whole prefix of such n-grams has no link. Most classes end here; the test is one
   aggregation of min and max class per n-gram, so a frequent n-gram costs no more than others.
3. The classes left are dealt to groups by small n-gram keys, hot groups split in parts that all hold the
   group's leader. In each group a prefix tree finds links (see PrefixTree); components of links so far
   label the classes.
4. The test of 2 again, with components for classes: a class whose prefix stands in one component only
   has no link outside of it. The rest meet in groups by prefix n-gram, in order of rising frequency.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.llm.common import WordHashes, bounded, connected_components, join_skewed, map_arrow, mix, shingles, signed, staged

#: N-grams whose hash is below this share of all take part in the tests of steps 2 and 4.
SAMPLED = 0.3
_BOUND = np.uint64(int(SAMPLED * 2**64))
_SEEDS = tuple(np.uint64(0x51ED270B * (i + 1)) for i in range(4))


def lower_ascii(text: str) -> bytes:
    """UTF-8 with A-Z, and nothing else, in lower case."""
    return text.encode("utf-8", "replace").lower()


def ngram_set(text: str | None, hashes: WordHashes, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; the whole sequence is one if there are fewer words."""
    return np.unique(shingles(hashes.of(lower_ascii(text or "").split()), k))


def prefix_length(n, percent: int):
    """|x| - ceil(t |x|) + 1, in whole numbers; Columns and numbers alike."""
    return n - (n * percent + 99) // 100 + 1


def linked(shared: int, a: int, b: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared)


class PrefixTree:
    """Sets of ordered n-grams as a flattened trie: sets in lexicographic order, each with the length of
    the prefix it shares with the one before.

    A search walks the sets in order. The overlap counted along a shared prefix is kept, not counted
    again; where overlap so far plus what remains of the shorter side can't reach the bound, the whole
    subtree below that depth is skipped.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].tobytes())
        self.sets = [sets[i] for i in self.order]
        self.shared = [0]
        for a, b in zip(self.sets, self.sets[1:]):
            n = min(len(a), len(b))
            differs = np.flatnonzero(a[:n] != b[:n])
            self.shared.append(int(differs[0]) if len(differs) else n)

    def search(self, query: np.ndarray, member: np.ndarray, skip, percent: int):
        """(position, overlap) of sets linked with query; member: a flag for each id, true for query's."""
        depth, counts = 0, np.zeros(1, np.int64)  # overlap after 0, 1, ... n-grams of the path so far
        pruned = None  # depth of a node below which nothing can link
        q = len(query)
        for at, (s, lcp) in enumerate(zip(self.sets, self.shared)):
            if pruned is not None:
                if lcp >= pruned:
                    continue
                pruned = None
            depth = min(depth, lcp)
            n = len(s)
            if n * 100 < percent * q or q * 100 < percent * n or skip(at):
                continue
            step = max(8, n // 4)
            while depth < n:
                to = min(n, depth + step)
                more = counts[depth] + np.cumsum(member[s[depth:to]])
                counts = np.concatenate([counts[: depth + 1], more])
                short = more + np.minimum(n - np.arange(depth + 1, to + 1), q - more)
                bad = np.flatnonzero(short * (100 + percent) < percent * (n + q))
                if len(bad):
                    # a longer or shorter set below this node has another bound, so only equal lengths are sure
                    depth = depth + int(bad[0]) + 1
                    if self._same_length_below(at, depth, n):
                        pruned = depth
                    break
                depth = to
            else:
                shared = int(counts[n])
                if linked(shared, n, q, percent):
                    yield at, shared

    def _same_length_below(self, at: int, depth: int, n: int) -> bool:
        for s, lcp in zip(self.sets[at + 1 :], self.shared[at + 1 :]):
            if lcp < depth:
                return True
            if len(s) != n:
                return False
        return True


def join_group(keys: np.ndarray, sets: list[np.ndarray], percent: int, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a group that connect it as all its links would: those inside a found component are left out.

    labels: components known before; links inside one are left out as well."""
    universe, flat = np.unique(np.concatenate(sets), return_inverse=True)
    frequency = np.bincount(flat, minlength=len(universe))
    rank = np.empty(len(universe), np.int64)  # rare first, then by hash: an order that all sets here share
    rank[np.lexsort((universe, frequency))] = np.arange(len(universe))
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    local = [np.sort(x) for x in np.split(rank[flat], cuts)]
    big_endian = [x.astype(">u4") for x in local]
    tree = PrefixTree(big_endian)
    tree.sets = [local[i] for i in tree.order]
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if labels is not None:
        first: dict[int, int] = {}
        for i, x in enumerate(labels.tolist()):
            parent[i] = first.setdefault(x, i)
    out, member = [], np.zeros(len(universe), bool)
    for i in range(len(sets)):
        member[local[i]] = True
        for at, _ in tree.search(local[i], member, lambda at, i=i: root(tree.order[at]) == root(i), percent):
            a, b = root(tree.order[at]), root(i)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(keys[tree.order[at]]), int(keys[i])))
        member[local[i]] = False
    return out


def _links(groups: DataFrame, percent: int) -> DataFrame:
    """groups: (g, part, cls, label, grams) -> links (a, b)."""

    def run(t: pa.Table) -> pa.Table:
        seen, rows = set(), []
        for i, c in enumerate(t.column("cls").to_pylist()):
            if c not in seen:
                seen.add(c)
                rows.append(i)
        t = t.take(rows)
        keys, labels = t.column("cls").to_numpy(), t.column("label").to_numpy()
        if len(t) < 2 or (labels == labels[0]).all():
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        grams = t.column("grams").combine_chunks()
        sets = [np.asarray(x.values.to_numpy(zero_copy_only=False)).view(np.uint64) for x in grams]
        links = join_group(keys, sets, percent, labels)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return groups.groupBy("g", "part").applyInArrow(run, "a long, b long")


def _only_one(postings: DataFrame, label: str) -> DataFrame:
    """(label, alone): how many sampled n-grams of each label stand in no other label."""
    one = postings.groupBy("gram").agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo = hi")
    return one.groupBy(F.col("lo").alias("s1")).agg(F.count(F.lit(1)).alias("alone"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, mark): set size, a 128-bit hash of the set and a 64-bit one of the text, of each document."""
    box: list[WordHashes] = []

    def run(batch: pa.RecordBatch):
        if not box:
            box.append(WordHashes())
        n, s1, s2 = [], [], []
        for t in batch.column(1).to_pylist():
            g = ngram_set(t, box[0], k)
            n.append(len(g))
            s1.append(g.sum(dtype=np.uint64))
            s2.append(mix(g ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), signed(np.array(s1, np.uint64)), signed(np.array(s2, np.uint64)), batch.column(2)], names=["doc_id", "n_shingles", "s1", "s2", "mark"])

    return map_arrow(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark")), run, "doc_id long, n_shingles long, s1 long, s2 long, mark long")


def _sampled(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(gram, s1) for the n-grams below the hash bound, once per document."""
    box: list[WordHashes] = []

    def run(batch: pa.RecordBatch):
        if not box:
            box.append(WordHashes())
        grams, own = [], []
        for t in batch.column(0).to_pylist():
            g = ngram_set(t, box[0], k)
            low = g[g < _BOUND]
            grams.append(low)
            own.append(np.full(len(low), g.sum(dtype=np.uint64), np.uint64))
        yield pa.RecordBatch.from_arrays([signed(np.concatenate(grams)), signed(np.concatenate(own))], names=["gram", "s1"]) if grams else batch.slice(0, 0)

    return map_arrow(docs.select(F.col(text).alias("text")), run, "gram long, s1 long")


def _with_grams(docs: DataFrame, ids: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(cls, n, s1, keys, grams) of the classes in ids (cls, least, s1), from the document `least` of each."""
    box: list[WordHashes] = []

    def run(batch: pa.RecordBatch):
        if not box:
            box.append(WordHashes())
        cls, n, s1, ks, gs = [], [], [], [], []
        for c, s, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
            g = ngram_set(t, box[0], k)
            if not len(g) or int(g.sum(dtype=np.uint64).view(np.int64)) != s:
                continue
            cls.append(c), n.append(len(g)), s1.append(s), gs.append(g.view(np.int64))
            ks.append([int(mix(g ^ x).min().view(np.int64)) for x in _SEEDS])
        yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(ks, pa.list_(pa.int64())), pa.array(gs, pa.list_(pa.int64()))], names=["cls", "n", "s1", "keys", "grams"])

    d = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    few = ids.limit(500_001).count() <= 500_000  # 24 bytes each: 12 MB at most are broadcast
    d = d.join(F.broadcast(ids) if few else ids, F.col("id") == F.col("least")).select("cls", "s1", "text")
    return map_arrow(d, run, "cls long, n long, s1 long, keys array<long>, grams array<long>").dropDuplicates(["cls"])


def similarity_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, k: int = 5, group_rows: int = 192) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of docs.

    component_id is the smallest doc_id reachable by links, itself included. Null and wordless texts have
    an empty set and link with nothing, not even with each other; texts of any length are read whole;
    columns of any other name are left out; a null doc_id among equal sets takes
    their component, alone it stays null. Rows that repeat a doc_id count as documents of their own, and
    share a component only if their sets are linked. An empty table gives no rows.
    """
    return _components(docs, key, text, percent, k, group_rows).select("doc_id", "n_shingles", "component_id")


def _components(docs: DataFrame, key: str, text: str, percent: int = 80, k: int = 5, group_rows: int = 192) -> DataFrame:
    """similarity_classes with the mark of each row's text, and `low`: the smallest (doc_id, mark) of its component.

    Classes have ids of their own, as two classes can have the same smallest doc_id."""
    docs = docs.select(F.col(key), F.col(text)) if key != text else docs
    per_doc = staged(classes(docs, key, text, k))
    cls = per_doc.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark"))).alias("low"), F.min("n_shingles").alias("n"))
    cls = staged(cls.withColumn("cls", F.monotonically_increasing_id()))
    alone = _only_one(_sampled(docs, key, text, k), "s1")
    live = cls.where("low is not null").join(alone, "s1", "left").where(F.coalesce("alone", F.lit(0)) < _prefix("n", percent))
    sets = staged(_with_grams(docs, staged(live.select("cls", F.col("low.doc_id").alias("least"), "s1")), key, text, k))

    # step 3: groups around a leader, for each of the keys
    posted = sets.select("cls", F.posexplode("keys").alias("j", "key"))
    leaders = staged(posted.groupBy("j", "key").agg(F.min("cls").alias("g"), F.count(F.lit(1)).alias("m")).where("m > 1"))
    dealt = staged(join_skewed(posted, leaders, ["j", "key"], "m").select("g", "cls").where("g <> cls").distinct())
    sizes, parts = _parts(dealt, group_rows)
    heads = sizes.select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("g").alias("cls"))
    plain = sets.select("cls", F.col("cls").alias("label"), "grams")
    links = staged(_links(parts.union(heads).join(plain, "cls"), percent))
    labels = connected_components(links)

    # step 4: what may still link across components
    sets = sets.join(labels.withColumnRenamed("id", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    sets = staged(sets.select("cls", "n", "label", "grams"))
    low = int(_BOUND)
    below = lambda g: (g >= 0) & (g < low) if low < 2**63 else (g >= 0) | (g < low - 2**64)
    grams = sets.select("cls", "label", F.explode(F.filter("grams", below)).alias("gram"))
    mixed = grams.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("gram")
    shared = grams.join(mixed, "gram", "left_semi").groupBy("cls").agg(F.count(F.lit(1)).alias("shared"))
    own = sets.select("cls", "n", F.size(F.filter("grams", below)).alias("low")).join(shared, "cls")
    open_ = own.where(F.col("low") - F.col("shared") < _prefix("n", percent)).select("cls")
    # a class without any mixed n-gram among the sampled ones has none to lose only if those make a prefix
    bare = sets.where(F.size(F.filter("grams", below)) < _prefix("n", percent)).select("cls")
    rest = staged(sets.join(open_.union(bare).distinct(), "cls", "left_semi"))
    all_grams = rest.select("cls", "label", "n", F.explode("grams").alias("gram"))
    df = all_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    ranked = all_grams.join(df, "gram").groupBy("cls", "n", "label").agg(F.sort_array(F.collect_list(F.struct(F.when(F.col("lo") != F.col("hi"), F.col("df")).otherwise(F.lit(0)).alias("many"), "gram"))).alias("o"))
    prefix = ranked.select("cls", "label", "n", F.posexplode(F.expr(f"slice(o, 1, int(n - floor((n * {percent} + 99) / 100) + 1))")).alias("pos", "p")).where("p.many > 0")
    prefix = staged(prefix.select("cls", "label", "n", "pos", F.col("p.gram").alias("gram")))
    # at the first n-gram that two linked sets share, what follows on either side must suffice
    x, y = prefix.alias("x"), prefix.alias("y")
    enough = f"least(x.n - x.pos, y.n - y.pos) * {100 + percent} >= {percent} * (x.n + y.n)"
    pairs = x.join(y, F.expr(f"x.gram = y.gram and x.label <> y.label and x.cls < y.cls and {enough}"))
    pairs = staged(pairs.select(F.col("x.cls").alias("g"), F.col("y.cls").alias("cls")).distinct())
    sizes, met = _parts(pairs, group_rows)
    heads = sizes.select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("g").alias("cls"))
    late = staged(_links(met.union(heads).join(rest.select("cls", "label", "grams"), "cls"), percent))
    final = connected_components(links.union(late))
    final = final.withColumnRenamed("id", "cls")
    lowest = final.join(cls, "cls").groupBy("label").agg(F.min("low").alias("lowest"))
    cls = cls.join(final.join(lowest, "label"), "cls", "left").select("s1", "s2", F.coalesce("lowest", "low").alias("low"))
    out = per_doc.join(cls, ["s1", "s2"], "left")
    return out.select("doc_id", "n_shingles", "mark", "low", F.coalesce("low.doc_id", "doc_id").alias("component_id"))


def _parts(dealt: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """(g, m, parts) and (g, part, cls): the members of each group of staged (g, cls), in parts of about so many rows."""
    sizes = dealt.groupBy("g").agg(F.count(F.lit(1)).alias("m"))
    sizes = staged(sizes.withColumn("parts", F.ceil(F.col("m") / F.lit(rows)).cast("int")))
    met = join_skewed(dealt, sizes, ["g"], "m")
    return sizes, met.select("g", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int").alias("part"), "cls")


def _prefix(n: str, percent: int):
    return F.expr(f"{n} - floor(({n} * {percent} + 99) / 100) + 1")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each similarity class, with its smallest key; rows with a null key or without words stay.

    Where that key has several texts of the class, the text with the smallest hash stays; of equal texts any."""
    d = staged(_components(docs, key, text, **options).where("low is not null and doc_id is not null").select("doc_id", "mark", "low"))
    own = F.struct("doc_id", "mark") == F.col("low")
    ids = [F.col("doc_id").alias("__pointmill_id"), F.col("mark").alias("__pointmill_mark")]
    at = (F.col(key) == F.col("__pointmill_id")) & (F.xxhash64(text) == F.col("__pointmill_mark"))
    gone, twice = staged(d.where(~own).select(*ids).distinct()), d.where(own).groupBy(*ids).count().where("count > 1").drop("count")
    kept = docs.join(bounded(gone, 500_000), at, "left_anti")
    twice = staged(twice)
    if twice.isEmpty():
        return kept
    twice = bounded(twice, 500_000)
    row = F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("__pointmill_row")
    one = kept.join(twice, at, "left_semi").groupBy(F.col(key).alias("__pointmill_id"), F.xxhash64(text).alias("__pointmill_mark")).agg(row)
    return kept.join(twice, at, "left_anti").unionByName(one.select("__pointmill_row.*"))
