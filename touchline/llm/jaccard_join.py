"""Exact n-gram Jaccard join with token-combination prefixes.

A document's set is its distinct SHINGLE-word shingles; documents with one set are one node. Tokens
are rare or frequent by the number of documents that have them, counted over all documents. Each set
is ordered: rare tokens first, then frequent ones, by hash within a class. Let a set of n tokens be able
to lose d of them and still reach a link.

- Rare tokens are indexed one by one, as far as they are among the first d + 1 tokens: two linked sets
  that share a rare token share one there.
- A set whose first d + 1 tokens are not all rare can also have links without a common rare token. Its
  prefix is then extended and combinations of COMBINED neighbouring frequent tokens are indexed. The
  first e common tokens lie within the first d + e, and a token that only one of the sets has can part
  one pair of neighbours, so with e two more than the tokens that both sets may lack together, some
  pair of common tokens is neighbouring in both. The keys of a set are fewer than its tokens.

Which tokens are frequent is decided by a bit filter of fixed size over those that more than some
number of documents have; the number doubles from MIN_FREQUENT until at most MAX_FREQUENT tokens are
left. Any classes give the same links, as long as they are the same everywhere; they only set the work.

The index is dealt by key and sorted, and tasks stream over the runs of equal keys:

- Under a rare token are no more sets than the bound of its class, so its pairs are emitted at once. Each
  pair is counted over all its tokens; of the prefix that ends first every shared rare token is counted,
  which bounds the overlap, and pairs that it rules out are not verified.
- Under a combination can be any number of sets. A row carries the number of frequent tokens of its set,
  which bounds the overlap of two sets that share no rare token (those that do are found above): sets with
  many rare tokens of their own meet nobody. Star rounds come first: each key proposes one hub, its node
  with the largest share of frequent tokens, and each node is compared with the hub that most of its keys
  propose. Verified links are merged into components, keys whose nodes are all of one component drop out,
  and the last round has all candidates that still lie in different components. Two nodes that were both
  compared with one hub are none if that rules them out: what they share is in the hub, or is what one
  of them has besides it.

Every link is verified on the whole sets, which are dealt by hub; a hub with many partners is dealt to
several tasks. So a group of copies costs links in proportion to its size, and no link between
components is lost.

Defined cases: null, empty or blank texts have an empty set and link with nothing; texts of fewer
words are one shingle; sets of one token link only with their equals; repeated rows are one node, rows of
one id with unlike texts are nodes of their own and each gets a row; very long texts are handled whole,
one at a time in a task; documents without an id are given back with a null component and link with
nothing, as nothing could name them; an empty table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, SPACED, U64, Chunk, chunks, mix, odd, signed, window_hash, words
from .bits import BitFilter, bit_filter
from .components import components
from .regions import RangeHash, shared_table

SHINGLE = 5
PERCENT = 75
COMBINED = 2
#: A token is frequent above so many documents, or above the next double that leaves MAX_FREQUENT tokens.
MIN_FREQUENT = 16
MAX_FREQUENT = 1 << 22
STAR_ROUNDS = 2
PARTNERS_PER_TASK = 2000
MAX_RUN = 2_000_000
#: Tokens that a task holds before it sends them to be counted, and tokens counted at once.
HELD_TOKENS = 1_000_000
BLOCK_TOKENS = 2_000_000
_A, _B = odd(401, 2)
#: Kinds of the rows of the index: (x, y, m, k) is
#: for a document (doc, node, size, whether it has an id),
#: for a node (last rare token of its prefix, node, size, tokens up to there, or -1 - rare tokens when it has them all),
#: for a rare token (token, node, size, 0), for a combination (key, node, size, frequent tokens of the set), for a pair (a, b, size of a, size of b).
DOCUMENT, PREFIX, TOKEN, COMBINATION, PAIR = range(5)
_ROWS = "kind int, x long, y long, m int, k int"


def shingle_sets(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(distinct tokens of each document in ascending order, offsets)."""
    w = words(c, SPACED, LOWER[c.data])
    h = window_hash(w.hash, SHINGLE)
    doc = w.doc[: len(h)]
    inside = doc == w.doc[SHINGLE - 1 :] if len(h) else np.zeros(0, bool)
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    whole = mix(RangeHash(w.hash).of(w.first[short], w.first[short + 1])) if len(short) else np.zeros(0, U64)
    token, doc = np.concatenate((h[inside], whole)), np.concatenate((doc[inside], short))
    order = np.lexsort((token, doc))
    token, doc = token[order], doc[order]
    new = np.concatenate(([True], (token[1:] != token[:-1]) | (doc[1:] != doc[:-1]))) if len(token) else np.zeros(0, bool)
    token, doc = token[new], doc[new]
    return token, np.searchsorted(doc, np.arange(c.n + 1))


def set_ids(token: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Hash of each document's set, 0 for an empty one."""
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, U64), np.cumsum(mix(token ^ _A))))
        n = np.diff(offs).astype(U64)
        return np.where(n > 0, mix(sums[offs[1:]] - sums[offs[:-1]] + n * _B) | U64(1), U64(0))


def _short(token: np.ndarray, bits: int) -> np.ndarray:
    """The first `bits` bits of tokens, which stand for them in counts and classes."""
    return token >> U64(64 - bits)


def largest_partner(n: np.ndarray, overlap: np.ndarray) -> np.ndarray:
    """Largest size of a set that a set of n tokens can be linked with by so large an overlap."""
    return (100 + PERCENT) * overlap // PERCENT - n


def prefix_keys(token: np.ndarray, offs: np.ndarray, often: np.ndarray):
    """Rows of the index of each set; often flags the frequent tokens.

    (document, token) of rare tokens, (document, key, frequent tokens) of combinations, and by document
    the last rare token of its prefix and the number of tokens up to there, or -1 - that of all rare tokens.
    """
    n = np.diff(offs)
    doc = np.repeat(np.arange(len(n)), n)
    loss = n - (PERCENT * n + 99) // 100
    order = np.argsort(2 * doc + often, kind="stable")
    token, often = token[order], often[order]
    rare = np.bincount(doc[~often], minlength=len(n))
    place = np.arange(len(token)) - np.repeat(offs[:-1], n)
    hold = ~often & (place <= loss[doc]) & (n[doc] > 1)
    docs, keys, common = [], [], []
    # the tokens that only one of two linked sets has, at most
    apart = (n + 100 * n // PERCENT) * (100 - PERCENT) // (100 + PERCENT) - rare
    for d in np.flatnonzero((n > 1) & (rare <= loss) & (apart >= 0)).tolist():
        first = offs[d] + rare[d]
        own = token[first : min(offs[d + 1], first + loss[d] - rare[d] + (COMBINED - 1) * apart[d] + COMBINED)]
        key = window_hash(own, COMBINED, 2)
        docs.append(np.full(len(key), d))
        keys.append(key)
        common.append(np.full(len(key), n[d] - rare[d]))
    none = np.zeros(0, np.int64)
    whole = rare <= loss
    last = np.zeros(len(n), dtype=U64)
    ends = np.flatnonzero((n > 1) & ~whole)
    last[ends] = token[offs[ends] + loss[ends]]
    joined = [np.concatenate(x) if x else none for x in (docs, keys, common)]
    return (doc[hold], token[hold]), (joined[0], joined[1].astype(U64), joined[2]), (last, np.where(whole, -1 - rare, loss + 1))


def _distinct_sets(batches, text: int):
    """(chunk, batch, tokens, offsets, set ids, first of its set in this task) of each chunk of texts."""
    seen: set[int] = set()
    for batch in batches:
        for c in chunks(batch.column(text)):
            token, offs = shingle_sets(c)
            sets = set_ids(token, offs)
            fresh = np.zeros(c.n, dtype=bool)
            for k, s in enumerate(sets.tolist()):
                if s and s not in seen:
                    seen.add(s)
                    fresh[k] = True
            yield c, batch, token, offs, sets, fresh


def _token_counts(docs: DataFrame, block_bits: int) -> DataFrame:
    """(token, n): first block_bits + 32 bits of tokens that more than MIN_FREQUENT sets have.

    Tasks send their tokens as arrays, one for each of 2 ** block_bits ranges of hashes, and count one
    range after the other. Equal sets of one task count once.
    """

    def emit(batches):
        held, size = [], 0

        def rows():
            short = np.sort(_short(np.concatenate(held), block_bits + 32))
            block = short >> U64(32)
            cut = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
            low = (short & U64(0xFFFFFFFF)).astype(np.uint32)
            for at in range(0, len(cut) - 1, 1000):
                ends = cut[at : at + 1001]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block[ends[:-1]].astype(np.int64)), pa.array([low[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())],
                    names=["block", "tokens"],
                )

        for _, _, token, offs, _, fresh in _distinct_sets(batches, 1):
            held.append(token[np.repeat(fresh, np.diff(offs))])
            size += len(held[-1])
            if size >= HELD_TOKENS:
                yield from rows()
                held, size = [], 0
        if size:
            yield from rows()

    def count(batches):
        held, name = [], None

        def rows():
            low = np.sort(np.concatenate(held))
            head = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
            n = np.diff(np.append(head, len(low)))
            on = n > MIN_FREQUENT
            token = (U64(name) << U64(32)) | low[head[on]].astype(U64)
            yield pa.RecordBatch.from_arrays([pa.array(signed(token)), pa.array(n[on].astype(np.int64))], names=["token", "n"])

        for batch in batches:
            block, blob = batch.column(0).to_numpy(), batch.column(1)
            for k in range(batch.num_rows):
                if block[k] != name and held:
                    yield from rows()
                    held = []
                name = int(block[k])
                held.append(np.frombuffer(blob[k].as_buffer(), dtype=np.uint32).copy())
        if held:
            yield from rows()

    sent = docs.mapInArrow(emit, "block long, tokens binary")
    return sent.repartition("block").sortWithinPartitions("block").mapInArrow(count, "token long, n long")


def frequent_tokens(docs: DataFrame) -> tuple[BitFilter, int]:
    """(filter of the frequent tokens' first bits, how many bits)."""
    # a token for each word, and a word for about six bytes
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block_bits = min(31, max(0, int(np.ceil(np.log2(max(1, size / 6 / BLOCK_TOKENS))))))
    counts = shared_table(_token_counts(docs, block_bits), "frequent")
    doubles = sorted(counts.groupBy(F.floor(F.log2(F.col("n") / MIN_FREQUENT)).alias("b")).agg(F.count("*").alias("k")).collect(), reverse=True)
    total, least = 0, 0
    for b, k in doubles:
        total += k
        if total > MAX_FREQUENT:
            least = b + 1
            break
    found = bit_filter(counts.where(F.col("n") >= MIN_FREQUENT * 2**least).select("token"))
    return found, block_bits + 32


def _rows(kind: int, x, y, m, k) -> pa.RecordBatch:
    """Rows of one kind."""
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(x), kind, dtype=np.int32)), pa.array(x), pa.array(y), pa.array(m.astype(np.int32)), pa.array(k.astype(np.int32))],
        names=["kind", "x", "y", "m", "k"],
    )


def _index(docs: DataFrame, frequent: BitFilter, bits: int) -> DataFrame:
    """Rows for documents, nodes, combinations with a possible partner, and pairs of nodes (one for each shared rare token)."""

    def emit(batches):
        for c, batch, token, offs, sets, fresh in _distinct_sets(batches, 1):
            n, node = np.diff(offs), signed(sets)
            use = np.repeat(fresh, n)
            own = np.concatenate(([0], np.cumsum(np.where(fresh, n, 0))))
            (d, rare), (e, key, common), (last, used) = prefix_keys(token[use], own, frequent.has(_short(token[use], bits)))
            yield _rows(TOKEN, signed(rare), node[d], n[d], np.zeros(len(d)))
            yield _rows(COMBINATION, signed(key), node[e], n[e], common)
            f = np.flatnonzero(fresh & (n > 1))
            yield _rows(PREFIX, np.where(used[f] < 0, node[f], signed(last)[f]), node[f], n[f], used[f])
            ids = batch.column(0).slice(c.first, c.n)
            named = np.asarray(ids.is_valid())
            # a row without an id goes anywhere
            doc = np.where(named, ids.fill_null(0).to_numpy(), signed(mix(np.arange(c.n, dtype=U64))))
            yield _rows(DOCUMENT, doc, node, n, named)

    def runs(kind, x, y, m, k):
        """Other rows as they are, pairs of the nodes of rare tokens, and combinations with a possible partner."""
        out = kind < TOKEN
        on = np.flatnonzero(kind == COMBINATION)
        _keep_possible(out, on[_fresh(x[on], y[on])], x, m, k)
        t = np.flatnonzero(kind == TOKEN)
        t = t[_fresh(x[t], y[t])]
        step, found = 1, []
        while step < len(t):
            left = np.flatnonzero(x[t[:-step]] == x[t[step:]])
            if not len(left):
                break
            a, b = t[left], t[left + step]
            fits = (100 * np.minimum(m[a], m[b]).astype(np.int64)) >= PERCENT * np.maximum(m[a], m[b]).astype(np.int64)
            a, b = a[fits], b[fits]
            found.append(_rows(PAIR, y[a], y[b], m[a], m[b]))
            step += 1
        return out, found

    return _streamed(docs.mapInArrow(emit, _ROWS), runs, _ROWS)


def _fresh(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Flags the first of equal rows; rows are sorted."""
    return np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(x) else np.zeros(0, bool)


def _keep_possible(out: np.ndarray, on: np.ndarray, key: np.ndarray, n: np.ndarray, common: np.ndarray) -> None:
    """Flag those of the rows `on` for which another row of their key may be a candidate."""
    run = np.cumsum(np.concatenate(([True], key[on][1:] != key[on][:-1]))) - 1 if len(on) else on
    many = np.bincount(run, minlength=1)[run] > 1
    on, run = on[many], np.unique(run[many], return_inverse=True)[1]
    if not len(on):
        return

    def other(value):
        """Least value of the other rows of each run."""
        order = np.lexsort((value, run))
        head = np.flatnonzero(np.concatenate(([True], run[order][1:] != run[order][:-1])))
        first, second = value[order[head]], value[order[head + 1]]
        least = first[run]
        least[order[head]] = second
        return least

    size = n[on].astype(np.int64)
    top = largest_partner(size, common[on].astype(np.int64))
    out[on[(other(size) <= top) & (-other(-top) >= size)]] = True


def _streamed(rows: DataFrame, work, schema: str) -> DataFrame:
    """Rows (kind, x, y, ...) that work(columns) flags, and the batches that it adds.

    It gets whole runs of equal x, sorted by x and y. A run longer than MAX_RUN, which only combinations
    can have, is handed over in parts; its parts are kept whole.
    """

    def run(batches):
        held, size = [], 0
        long_x = None

        def done(part, long):
            flags, more = work(*[c.to_numpy() for c in part.columns])
            if long is not None:
                flags = flags | (part.column(1).to_numpy() == long)
            return [*part.filter(pa.array(flags)).to_batches(), *more]

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < 20_000 or not batch.num_rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            x = table.column(1).to_numpy()
            cut = int(np.searchsorted(x, x[-1]))
            if cut or size >= MAX_RUN:
                over = None if cut else x[0]
                yield from done(table.slice(0, cut or size), long_x if over is None else over)
                long_x = over
                held, size = [b for b in table.slice(cut or size).to_batches() if b.num_rows], table.num_rows - (cut or size)
        if size:
            yield from done(pa.Table.from_batches(held), long_x)

    return rows.repartition("x").sortWithinPartitions("x", "y").mapInArrow(run, schema)


def _candidates(index: DataFrame) -> DataFrame:
    """(a, b): pairs that share rare tokens, unless their number proves that the overlap is too small."""
    pair = index.where(F.col("kind") == PAIR).groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.count("*").alias("c"), F.first("m").alias("na"), F.first("k").alias("nb"))
    prefix = index.where(F.col("kind") == PREFIX).groupBy("y").agg(F.first("x").alias("x"), F.first("k").alias("k"))
    # tokens compare as unsigned numbers
    last = F.when(F.col("k") >= 0, F.col("x").bitwiseXOR(F.lit(-(1 << 63))))
    used = F.when(F.col("k") >= 0, F.col("k")).otherwise(-1 - F.col("k"))
    for s in "ab":
        pair = pair.join(prefix.select(F.col("y").alias(s), last.alias(f"l{s}"), used.alias(f"u{s}")), s)
    by_a, by_b = F.col("c") + F.col("na") - F.col("ua"), F.col("c") + F.col("nb") - F.col("ub")
    # what the prefix that ends first does not share, it lacks; one with all rare tokens of its set has no end
    most = (
        F.when(F.col("la").isNull() & F.col("lb").isNull(), F.least(by_a, by_b))
        .when(F.col("lb").isNull() | (F.col("la") <= F.col("lb")), by_a)
        .otherwise(by_b)
    )
    return pair.where((100 + PERCENT) * most >= PERCENT * (F.col("na") + F.col("nb"))).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, classes: tuple[BitFilter, int]) -> DataFrame:
    """(a, b, linked, common) of each pair: whether the whole sets reach PERCENT, and their common frequent tokens.

    The sets of a are dealt to that of their b.
    """
    frequent, bits = classes
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / PARTNERS_PER_TASK).alias("parts"))
    dealt = pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"))
    jobs = dealt.select(F.col("a").alias("node"), F.col("b").alias("hub"), "part", F.lit(1).alias("turn"))
    jobs = shared_table(jobs.union(dealt.select(F.col("b").alias("node"), F.col("b").alias("hub"), "part", F.lit(0).alias("turn")).distinct()), "jobs")
    # the sets of documents that the filter lets through by mistake meet no job in the join
    wanted = bit_filter(jobs.select("node").distinct().join(nodes, "node").select("doc"))

    def fetch(batches):
        for batch in batches:
            ask = wanted.has(batch.column(0).to_numpy().view(U64))
            if not ask.any():
                continue
            for c in chunks(batch.column(1).filter(pa.array(ask))):
                token, offs = shingle_sets(c)
                node = signed(set_ids(token, offs))
                often = frequent.has(_short(token, bits))
                for at in range(0, c.n, 500):
                    some = [(token[offs[r] : offs[r + 1]], often[offs[r] : offs[r + 1]]) for r in range(at, min(c.n, at + 500))]
                    yield pa.RecordBatch.from_arrays([pa.array(node[at : at + 500]), *[pa.array([t[k].tobytes() for t, k in part], pa.binary()) for part in ([(t, ~k) for t, k in some], some)]], names=["node", "rare", "frequent"])

    sets = docs.mapInArrow(fetch, "node long, rare binary, frequent binary").join(jobs, "node")
    sets = sets.select("hub", "part", "turn", "node", "rare", "frequent").repartition("hub", "part").sortWithinPartitions("hub", "part", "turn")

    def shared(x, y):
        both = np.sort(np.concatenate((x, y)))
        return int((both[1:] == both[:-1]).sum())

    def check(batches):
        name, lead = None, ()
        for batch in batches:
            hub, part, turn, node = (batch.column(i).to_numpy() for i in range(4))
            rows, linked, common = [], [], []
            for k in range(batch.num_rows):
                own = tuple(np.frombuffer(batch.column(i)[k].as_buffer(), dtype=U64) for i in (4, 5))
                if not turn[k]:
                    name, lead = (hub[k], part[k]), tuple(x.copy() for x in own)
                    continue
                assert name == (hub[k], part[k])
                of = shared(lead[1], own[1])
                same = of + shared(lead[0], own[0])
                rows.append(k)
                linked.append(100 * same >= PERCENT * (sum(map(len, lead)) + sum(map(len, own)) - same))
                common.append(of)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(node[rows]), pa.array(hub[rows]), pa.array(linked), pa.array(common, pa.int32())], names=["a", "b", "linked", "common"])

    return sets.mapInArrow(check, "a long, b long, linked boolean, common int").distinct()


def _partner(n: Column, frequent: Column) -> Column:
    """Largest size of a partner without a common rare token; see `largest_partner`."""
    return F.floor(frequent * (100 + PERCENT) / PERCENT) - n


def _stars(rows: DataFrame, turn: int) -> DataFrame:
    """(a, b): for each node the hub that most of its keys propose; rows have comp."""
    # ties go by a hash that changes
    rank = F.struct((F.col("f") / F.col("n")).alias("pure"), F.xxhash64("node", F.lit(turn)).alias("tie"), "node", "n", "f", "comp")
    top = rows.groupBy("key").agg(F.max(rank).alias("hub"))
    fits = (F.col("hub.n") <= _partner(F.col("n"), F.col("f"))) & (F.col("n") <= _partner(F.col("hub.n"), F.col("hub.f")))
    pair = rows.join(top, "key").where((F.col("comp") != F.col("hub.comp")) & fits)
    votes = pair.groupBy(F.col("node").alias("a"), F.col("hub.node").alias("b")).agg(F.count("*").alias("votes"))
    return votes.groupBy("a").agg(F.max(F.struct("votes", "b")).alias("v")).select("a", F.col("v.b").alias("b"))


def _across(rows: DataFrame) -> DataFrame:
    """(a, b): candidates of one key and different components; rows have comp, met (a hub) and common (with it)."""
    names = {"node": "", "n": "n", "f": "f", "comp": "c", "met": "m", "common": "o"}
    left, right = (rows.select("key", *[F.col(k).alias(v + x) for k, v in names.items()]) for x in "ab")
    fits = (F.col("nb") <= _partner(F.col("na"), F.col("fa"))) & (F.col("na") <= _partner(F.col("nb"), F.col("fb")))
    # common tokens are in the hub or are what one of both has besides it
    beside = F.least(F.col("oa") + F.col("fb") - F.col("ob"), F.col("ob") + F.col("fa") - F.col("oa"))
    ruled_out = (F.col("ma") == F.col("mb")) & ((100 + PERCENT) * beside < PERCENT * (F.col("na") + F.col("nb")))
    done = (F.col("a") == F.col("mb")) | (F.col("b") == F.col("ma"))
    pair = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & fits & ~F.coalesce(ruled_out, F.lit(False)) & ~F.coalesce(done, F.lit(False)))
    return pair.select("a", "b").distinct()


def linked(index: DataFrame, docs: DataFrame, nodes: DataFrame, classes: tuple[BitFilter, int]) -> DataFrame | None:
    """(node, component) of all nodes with a link; None when there is none."""
    rows = _combinations(index)
    now, comp, met = rows, None, None
    schema = "kind int, x long, y long, n int, f int, comp long, met long, common int"

    def several(kind, x, y, n, f, comp, *_):
        run = np.cumsum(np.concatenate(([True], x[1:] != x[:-1]))) - 1
        head = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        return (np.maximum.reduceat(comp, head) > np.minimum.reduceat(comp, head))[run], []

    for turn in range(STAR_ROUNDS + 1):
        pair = shared_table(_of_nodes(_stars(now, turn), nodes), "stars") if turn < STAR_ROUNDS else shared_table(_of_nodes(_across(now), nodes), "across")
        more = pair if turn else pair.union(_of_nodes(_candidates(index), nodes)).distinct()
        seen = shared_table(_verified(shared_table(more, "pairs"), docs, nodes, classes), "verified")
        if turn == 0 and STAR_ROUNDS:
            met = shared_table(pair.join(seen, ["a", "b"]).select(F.col("a").alias("node"), F.col("b").alias("met"), "common"), "met")
        fresh = seen.where("linked").select("a", "b")
        if not fresh.isEmpty():
            comp = components(fresh if comp is None else fresh.union(comp.toDF("a", "b")))
        if turn < STAR_ROUNDS:
            own = rows.drop("comp", "met", "common").join(met, "node", "left")
            own = own.join(comp.withColumnRenamed("component", "comp"), "node", "left") if comp is not None else own.withColumn("comp", F.lit(None))
            own = own.select(F.lit(COMBINATION).alias("kind"), F.col("key").alias("x"), F.col("node").alias("y"), "n", "f", F.coalesce("comp", "node").alias("comp"), F.coalesce("met", "node").alias("met"), F.coalesce("common", "f").alias("common"))
            kept = _streamed(own, several, schema)
            now = shared_table(kept.select(F.col("x").alias("key"), F.col("y").alias("node"), "n", "f", "comp", "met", "common"), "keys")
    return comp


def _combinations(index: DataFrame) -> DataFrame:
    """(key, node, n, f, comp, met, common): each node is a component of its own, and has met itself."""
    rows = index.where(F.col("kind") == COMBINATION).select(F.col("x").alias("key"), F.col("y").alias("node"), F.col("m").alias("n"), F.col("k").alias("f"))
    return rows.select("*", F.col("node").alias("comp"), F.col("node").alias("met"), F.col("f").alias("common"))


def _of_nodes(pair: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs without the nodes of documents that have no id."""
    for s in "ab":
        pair = pair.join(nodes.select(F.col("node").alias(s)), s, "left_semi")
    return pair.select("a", "b")


def _prepared(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, tuple[BitFilter, int]]:
    """(docs with an id, index, documents (doc, node, n), nodes of documents with an id, classes of tokens)."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    classes = frequent_tokens(plain)
    index = shared_table(_index(plain, *classes), "index")
    own = index.where(F.col("kind") == DOCUMENT).select(F.when(F.col("k") == 1, F.col("x")).alias("doc"), F.col("y").alias("node"), F.col("m").cast("long").alias("n"))
    nodes = own.where("n > 0 and doc is not null").groupBy("node").agg(F.min("doc").alias("doc"))
    return plain.where("doc_id is not null"), index, own, shared_table(nodes, "nodes"), classes


def pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every link (a, b), a < b, between documents with an id: those of one set, and those whose sets reach PERCENT.

    Unlike `join` it keeps the links inside a component, so its size is that of the links themselves.
    """
    plain, index, own, nodes, classes = _prepared(docs, doc_id, text)
    found = _across(_combinations(index)).union(_candidates(index)).distinct()
    near = _verified(shared_table(_of_nodes(found, nodes), "pairs"), plain, nodes, classes).where("linked").select("a", "b")
    both = near.union(nodes.select(F.col("node").alias("a"), F.col("node").alias("b"))).withColumnsRenamed({"a": "na", "b": "nb"})
    member = shared_table(own.where("n > 0 and doc is not null").select("node", "doc").distinct(), "members")
    both = both.join(member.toDF("na", "a"), "na").join(member.toDF("nb", "b"), "nb").where("a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach; null without an id)."""
    plain, index, own, nodes, classes = _prepared(docs, doc_id, text)
    found = linked(index, plain, nodes, classes)
    if found is None:
        named = nodes.select("node", F.col("doc").alias("component_id"))
    else:
        comp = nodes.join(found, "node", "left").select("node", "doc", F.coalesce("component", "node").alias("component"))
        comp = shared_table(comp, "components")
        least = comp.groupBy("component").agg(F.min("doc").alias("component_id"))
        named = comp.join(least, "component").select("node", "component_id")
    out = own.join(named, "node", "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc"))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))
