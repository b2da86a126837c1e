"""Near copies by exact Jaccard similarity of word shingles: a join with adaptive multi-match prefixes.

A document's set are its distinct shingles of ``shingle`` words.  Shingles are ordered by how many
documents have them (rarest first, then by hash).  Two sets that are similar enough share one shingle
in prefixes of ``n - ceil(t n) + 1``, and l of them in prefixes that are l - 1 longer.

1. Count every shingle's documents (a sharded count join).  A shingle of one document has no partner, so
   a document whose prefix holds only such shingles is finished; of the others, only the shared shingles
   go on.  Equal sets become one representative.
2. Deal representatives to blocks of bounded size by a min-hash, so that copies meet.  Each block asks the
   shards which blocks share its prefix shingles, and sends the sets concerned to the tasks of two blocks.
3. In a task each document lengthens its prefix to the l that makes the estimated candidate cost least;
   a pair needs as many shared prefix shingles as the smaller l of both, and is then verified in full.
   Pairs that verified links already connect are skipped: only reachability is asked for.
4. Components of the links (a spanning forest per task) over the representatives.

No prefix shingle's documents ever meet in one place; a hot one costs its blocks' pairs.  Hashes are
64-bit: two different shingles are taken for one with a chance of 2**-64.

Defined cases: null, empty or wordless texts have no shingle and link to nothing; a text of fewer words
has its whole sequence as its one shingle; rows that repeat are one document in every count; ids that
are null never become a component's id unless alone; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import blocks as bl
from quire.operators.graph import connected_components
from quire.session import cut_lineage

BLOCK_REPS = 512          # representatives in one block at most (two in a task)
VERIFY_COST = 100         # of a verification, in entries of a posting list
LONGEST = 64              # matches asked for at most


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    buf, off = bl.text_bytes(texts)
    out: list[np.ndarray] = []
    for lo, hi in bl.doc_runs(off):
        h, at = bl.word_hashes(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], bl.SPACED)
        w, doc = bl.window_hashes(h, at, k)
        cut = np.append(0, np.cumsum(np.bincount(doc, minlength=hi - lo)))
        out += [np.unique(w[cut[i]:cut[i + 1]]) for i in range(hi - lo)]
    return out


def prefix_size(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return n - -(-percent * n // 100) + 1


def matches_asked(df: np.ndarray, base: int) -> int:
    """The l of least estimated cost: reading the prefix's postings, and verifying the candidates, of
    which each takes l postings at least.  ``base``: shared shingles in the prefix of l = 1."""
    top = max(1, min(LONGEST, len(df) - base + 1))
    read = np.cumsum(df - 1)[base - 1: base - 1 + top].astype(float)
    asked = np.arange(1, len(read) + 1)
    return int(asked[np.argmin(read * (1 + VERIFY_COST / asked))])


def _flat(parts: list[np.ndarray], kind=np.uint64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def links_between(left: tuple, right: tuple | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two blocks' sets (within one, if ``right`` is None).
    A block: rep, set size, shared shingles in the first prefix, l, and the sets in order of rarity."""
    rep, size, base, asked = (np.concatenate([a, b]) if right else a for a, b in zip(left[:4], (right or left)[:4]))
    sets = left[4] + (right[4] if right else [])
    side = np.repeat([0, 1], [len(left[0]), len(right[0]) if right else 0])
    n = len(rep)
    _, number = np.unique(_flat(sets), return_inverse=True)
    cut = np.append(0, np.cumsum([len(s) for s in sets]))
    ids = [number[cut[i]:cut[i + 1]] for i in range(n)]
    prefix = [x[: b + a - 1] for x, b, a in zip(ids, base, asked)]
    # pairs that share prefix shingles, by posting lists
    owner = np.repeat(np.arange(n), [len(x) for x in prefix])
    token = _flat(prefix, np.int64)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    cuts = np.append(np.flatnonzero(np.append(True, token[1:] != token[:-1])), len(token))
    shared = np.zeros((n, n), np.uint32)
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a > 1:
            who = owner[a:b]
            shared[np.ix_(who, who)] += 1
    need = np.minimum(asked[:, None], asked[None, :])
    small, large = np.minimum(size[:, None], size[None, :]), np.maximum(size[:, None], size[None, :])
    able = (shared >= need) & (shared > 0) & (100 * small >= percent * large)
    if right:
        able &= side[:, None] != side[None, :]
    able = np.triu(able, 1)
    group = np.arange(n)
    mark = np.zeros(int(number.max()) + 1 if len(number) else 1, bool)
    a_out, b_out = [], []
    for x in np.flatnonzero(able.any(axis=1)):
        ys = np.flatnonzero(able[x])
        ys = ys[group[ys] != group[x]]
        if not len(ys):
            continue
        mark[ids[x]] = True
        both = np.add.reduceat(mark[_flat([ids[y] for y in ys], np.int64)].astype(np.int64),
                               np.cumsum([0] + [len(ids[y]) for y in ys[:-1]]))
        mark[ids[x]] = False
        for y in ys[100 * both >= percent * (size[x] + size[ys] - both)]:
            if group[y] != group[x]:
                group[group == group[y]] = group[x]
                a_out.append(x)
                b_out.append(y)
    return rep[a_out], rep[b_out]


def near_copies(docs: DataFrame, groups: int, shingle: int = 3, percent: int = 90, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``key, doc_id, n_shingles, component_id, cluster`` of every row; component: the smallest reachable id;
    cluster: a key that all rows linked with each other share, whatever their ids (its own key, if alone)."""
    dealt = bl.blocked(docs, groups, id_col, text_col)

    def own_sets(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Row numbers of the first row of each key, and its set."""
        keys = rows.column("key").to_numpy()
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
        return first, which, shingle_sets(rows.column("text").combine_chunks().take(pa.array(first)), shingle)

    def request(block: int, rows: pa.Table) -> pa.Table:
        u, count = np.unique(_flat(own_sets(rows)[2]), return_counts=True)
        return bl.requests(block, u, groups, count)

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        first, which, sets = own_sets(rows)
        u = np.unique(_flat(sets))
        df = bl.answers_of(answers) // 2
        n, ones, two, shared = [], [], [], []
        for s in sets:
            d = df[np.searchsorted(u, s)]
            n.append(len(s))
            x = bl.mix(s)
            ones.append(int(x.sum(dtype=np.uint64).view(np.int64)))
            two.append(int(bl.mix(x + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)))
            common = d > 1
            alone = len(s) - int(common.sum())
            if len(s) and alone < prefix_size(len(s), percent):
                s, d = s[common], d[common]
                order = np.lexsort((s, d))
                shared.append(bl.pack(s[order], bl.smallest(d[order])))
            else:
                shared.append(None)
        return pa.table({"key": rows.column("key"), "doc_id": rows.column("doc_id"),
                         "n": pa.array(np.array(n, np.int64)[which]), "sig_a": pa.array(np.array(ones, np.int64)[which]),
                         "sig_b": pa.array(np.array(two, np.int64)[which]),
                         "shared": pa.array([shared[i] for i in which], pa.binary())})

    profiles = cut_lineage(bl.count_join(dealt, request, bl.total_counts, finish,
                                         "key long, doc_id long, n long, sig_a long, sig_b long, shared binary", groups))
    same = ["sig_a", "sig_b", "n"]
    able = profiles.filter("shared is not null")
    classes = able.groupBy(*same).agg(F.min("key").alias("rep"), F.min("doc_id").alias("least"),
                                      F.count_distinct("key").alias("members"))
    classes = cut_lineage(classes)
    reps = (able.select(*same, "shared", F.col("key").alias("rep")).dropDuplicates(["rep"])
            .join(classes.select("rep"), "rep", "left_semi").select("rep", "n", "shared"))
    labels = _components(classes.select(F.col("rep").alias("id")), cut_lineage(_links(reps, classes.count(), percent)))
    least = (classes.join(labels.withColumnRenamed("id", "rep"), "rep")
             .groupBy("cluster_id").agg(F.min("least").alias("component_id")))
    known = (classes.join(labels.withColumnRenamed("id", "rep"), "rep").join(least, "cluster_id")
             .select(*same, "component_id", F.col("cluster_id").alias("cluster")))
    return (profiles.select("key", "doc_id", *same).join(known, same, "left")
            .select("key", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
                    F.coalesce("cluster", "key").alias("cluster")))


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return connected_components(nodes, edges)


_TASK = "low int, high int, side int, payload binary"


def _links(reps: DataFrame, count: int, percent: int) -> DataFrame:
    """``src, dst`` links that connect all representatives that links connect."""
    homes = max(1, count * 2 // BLOCK_REPS)

    def place(batches):
        for batch in batches:
            home, second = [], []
            for value in batch.column("shared").to_pylist():
                tokens = bl.mix(bl.unpack(value)[0])
                home.append(int(bl.mix(tokens.min(keepdims=True))[0] % np.uint64(homes)))
                second.append(int(bl.mix(tokens + np.uint64(7)).min() >> np.uint64(1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32()), pa.array(second, pa.int64())],
                                             names=[*batch.schema.names, "home", "second"])

    placed = cut_lineage(reps.mapInArrow(place, "rep long, n long, shared binary, home int, second long"))
    # a home with more than a block's worth of sets is split by a second min-hash and the key
    size = placed.groupBy("home").agg(F.ceil(F.count(F.lit(1)) * 2 / BLOCK_REPS).alias("parts"))
    split = (placed.join(size, "home").withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.hash("second", "rep"), F.col("parts"))).otherwise(0)))
    first = size.select("home", "parts", (F.col("home").cast("long") * 65536).alias("base"))
    blocks = cut_lineage(split.join(first.select("home", "base"), "home")
                         .select(F.pmod(F.xxhash64("base", "part"), F.lit(1 << 31)).cast("int").alias("block"), "rep", "n", "shared"))
    shards = max(1, min(homes, 512))

    def own(rows: pa.Table) -> tuple:
        rep, n = rows.column("rep").to_numpy(), rows.column("n").to_numpy()
        sets, base, asked = [], [], []
        for r, size_, value in zip(rep, n, rows.column("shared").to_pylist()):
            s, df = bl.unpack(value)
            sets.append(s)
            base.append(int(prefix_size(int(size_), percent)) - (int(size_) - len(s)))
            asked.append(matches_asked(df.astype(np.int64), base[-1]))
        return rep, n, np.array(base, np.int64), np.array(asked, np.int64), sets

    def request(key: tuple, rows: pa.Table) -> pa.Table:
        block = own(rows)
        return bl.requests(key[0].as_py(), np.unique(_flat([s[:b] for s, b in zip(block[4], block[2])])), shards)

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        """For every block: which of its shingles (place in its request) other blocks have, and which."""
        who = table.column("block").to_numpy()
        parts = [bl.ungaps(bl.unpack(x)[0]) for x in table.column("payload").to_pylist()]
        hashes = _flat(parts)
        source = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        place_ = np.concatenate([np.arange(len(p)) for p in parts])
        order = np.argsort(hashes, kind="stable")
        h = hashes[order]
        cuts = np.append(np.flatnonzero(np.append(True, h[1:] != h[:-1])), len(h))
        to: list[list] = [[] for _ in parts]
        partner: list[list] = [[] for _ in parts]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a > 1:
                src = source[order[a:b]]
                for i, s in enumerate(src.tolist()):
                    to[s].append(np.full(b - a - 1, place_[order[a + i]]))
                    partner[s].append(who[np.delete(src, i)])
        return pa.table({"shard": pa.array([key[0].as_py()] * len(parts), pa.int32()), "block": pa.array(who, pa.int32()),
                         "payload": pa.array([bl.pack(p[len(p):], bl.smallest(_flat(t, np.int64)), _flat(q, np.int32).astype(np.int32))
                                              for p, t, q in zip(parts, to, partner)], pa.binary())})

    def send(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        me, block = int(rows.column("block")[0].as_py()), own(rows)
        rep, n, base, asked, sets = block
        tokens = np.unique(_flat([s[:b] for s, b in zip(sets, base)]))
        cut = bl.shard_cuts(tokens, shards)
        at, partner = [], []
        for shard, value in zip(answers.column("shard").to_pylist(), answers.column("payload").to_pylist()):
            _, place_, other = bl.unpack(value)
            at.append(place_.astype(np.int64) + cut[shard])
            partner.append(other)
        at, partner = _flat(at, np.int64), _flat(partner, np.int32)
        mine = np.searchsorted(tokens, _flat([s[:b] for s, b in zip(sets, base)]))
        row = np.repeat(np.arange(len(rep)), [min(b, len(s)) for s, b in zip(sets, base)])
        tasks = [(me, me, 0, np.arange(len(rep)))]
        for p in np.unique(partner):
            wanted = np.zeros(len(tokens), bool)
            wanted[at[partner == p]] = True
            tasks.append((min(me, int(p)), max(me, int(p)), int(me > p), np.unique(row[wanted[mine]])))
        payload = [bl.pack(rep[i], n[i], base[i], asked[i], np.array([len(sets[j]) for j in i], np.int64), _flat([sets[j] for j in i]))
                   for *_, i in tasks]
        return pa.table({"low": pa.array([t[0] for t in tasks], pa.int32()), "high": pa.array([t[1] for t in tasks], pa.int32()),
                         "side": pa.array([t[2] for t in tasks], pa.int32()), "payload": pa.array(payload, pa.binary())})

    def work(key: tuple, table: pa.Table) -> pa.Table:
        got = []
        for value in table.column("payload").to_pylist():
            rep, n, base, asked, sizes, flat = bl.unpack(value)
            cut = np.append(0, np.cumsum(sizes))
            got.append((rep, n, base, asked, [flat[cut[i]:cut[i + 1]] for i in range(len(rep))]))
        alone = key[0].as_py() == key[1].as_py()
        a, b = links_between(got[0], None if alone else got[1], percent) if alone or len(got) > 1 else (np.zeros(0, np.int64),) * 2
        return pa.table({"src": pa.array(a, pa.int64()), "dst": pa.array(b, pa.int64())})

    asked = blocks.groupBy("block").applyInArrow(request, bl.REQUEST)
    told = asked.groupBy("shard").applyInArrow(answer, bl.REQUEST)
    sent = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(send, _TASK)
    return sent.groupBy("low", "high").applyInArrow(work, "src long, dst long")
