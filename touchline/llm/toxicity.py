"""Toxicity by a weighted finite-state pattern grammar.

Five small transducers read the words of a clause one after the other and write them again, with what
they know about them. Each is a table of arcs (state, symbol) -> (state, symbol, weight):

- insult and threat turn words of their class into a match;
- negation: matches within the next SCOPE words after a negator are negated;
- reported speech: matches behind a reporting verb are reported, to the end of the clause;
- target: matches are addressed once a person was addressed or named in the clause, threats weigh less
  without one.

`compose` makes one transducer of two, whose states are pairs and whose weights are products; the five
are composed into the one that scoring runs, starting anew at each clause. What it writes for a match is
its pattern: (kind, negated, reported, addressed). A clause counts once, with its strongest
match: the strength of the word times the factor of the pattern. A document's score is one minus the
product of what its matched clauses leave; words that are no match only move states.

Strengths and factors are learned from a bounded, hash-chosen sample of labelled training rows
(MAX_FIT_DOCS), smoothed towards fixed priors: that of a pattern is its weight in the composed
transducer. Stems (beginnings of words, for inflected forms) that the sample shows in toxic documents
alone, after different words, join the lexicon as insults, in the longest form that keeps their documents
(see `narrowed`), so that a beginning of few letters never stands for words that the sample does not have. All
stems that the sample supports are kept; they are bounded by the sample. Scoring is a map over whole texts.

Letters A to Z and the Latin letters with marks of ISO 8859-1 are lower-cased.

Defined cases: null, empty or unmatched texts get the learned share of toxic documents without a match
(0.01 without labels), which may be above the threshold where most of them are toxic; repeated rows are
scored alike, and rows of one id each by its own text; very long texts are scored whole, one at a time
in a task; an empty table gives an empty table; other columns are kept by `score`, but a column with the
name of its result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import ALNUM, LOWER, Chunk, Words, chunks, words
from .language_id import fold

MAX_FIT_DOCS = 20_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
SCOPE = 3
#: A stem of so many characters is learned when it is in so many sampled toxic documents, after so many different words, and this pure.
STEM_SIZES = range(3, 13)
MIN_DOCS, MIN_CONTEXTS, MIN_PURITY = 5, 5, 0.9
#: Learned stems have so many letters at least, and go on while the longer ones keep this share of their documents.
MIN_STEM, SPECIFIC = 5, 0.9

# Word lists of the grammar's classes.
INSULTS = (
    "idiot idiots moron morons loser losers scum clown clowns stupid disgusting worthless pathetic trash garbage jerk fool "
    "dumb imbecile cretin vermin filth bastard bitch whore slut pig coward "
    "connard salaud imbécile crétin ordure dummkopf arschloch abschaum trottel idiota imbécil estúpido basura cabrón"
).split()
THREATS = "kill murder hurt destroy beat stab shoot strangle burn tuer frapper töten umbringen schlagen matar golpear".split()
TARGETS = (
    "you your yours yourself u ur he she they him her them his their tu toi te vous votre vos il elle ils elles "
    "du dich dir dein deine ihr euch er sie usted ustedes tú ti vosotros ellos ellas"
).split()
NEGATORS = "not no never nobody nothing isn aren wasn don doesn didn without pas ne jamais nicht kein keine nie niemals sin nunca".split()
REPORTERS = "said says say claimed called calls quoted wrote reported dit disait écrit sagte sagt schrieb dijo dice escribió".split()

OTHER, INSULT, THREAT, TARGET, NEGATOR, REPORTER = range(6)
_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b".!?;:\n")] = True


MATCH = "match"
CLASSES = ((OTHER,), (INSULT,), (THREAT,), (TARGET,), (NEGATOR,), (REPORTER,))
NEGATED_WEIGHT, REPORTED_WEIGHT, UNADDRESSED_WEIGHT = 0.4, 0.5, 0.7


class Transducer:
    """States from 0, input symbols, and an arc (next state, output symbol, weight) for each of both."""

    def __init__(self, states: int, symbols: tuple, arc):
        self.states, self.symbols = states, symbols
        self.arcs = {(s, x): arc(s, x) for s in range(states) for x in symbols}

    @property
    def written(self) -> tuple:
        return tuple(dict.fromkeys(y for _, y, _ in self.arcs.values()))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that gives what second writes when it reads what first writes."""
    pairs, arcs = {(0, 0): 0}, {}
    queue = [(0, 0)]
    for a, b in queue:
        for x in first.symbols:
            a2, y, v = first.arcs[a, x]
            b2, z, w = second.arcs[b, y]
            if (a2, b2) not in pairs:
                pairs[a2, b2] = len(pairs)
                queue.append((a2, b2))
            arcs[pairs[a, b], x] = (pairs[a2, b2], z, v * w)
    return Transducer(len(pairs), first.symbols, lambda s, x: arcs[s, x])


def matcher(kind: int, symbols: tuple) -> Transducer:
    """Words of a class become a match of that kind."""
    return Transducer(1, symbols, lambda s, x: (s, (x[0], MATCH), 1.0) if x == (kind,) else (s, x, 1.0))


def marker(symbols: tuple, states: int, after, weight) -> Transducer:
    """Matches get one more mark: whether the state is above 0; after(state, symbol) is the next state."""

    def arc(s, x):
        return (after(s, x), (*x, int(s > 0)), weight(x[0], s > 0)) if MATCH in x else (after(s, x), x, 1.0)

    return Transducer(states, symbols, arc)


def grammar() -> Transducer:
    g = matcher(INSULT, CLASSES)
    g = compose(g, matcher(THREAT, g.written))
    g = compose(g, marker(g.written, SCOPE + 1, lambda s, x: SCOPE if x == (NEGATOR,) else max(0, s - 1), lambda _, on: NEGATED_WEIGHT if on else 1.0))
    g = compose(g, marker(g.written, 2, lambda s, x: int(s or x == (REPORTER,)), lambda _, on: REPORTED_WEIGHT if on else 1.0))
    return compose(g, marker(g.written, 2, lambda s, x: int(s or x == (TARGET,)), lambda kind, on: UNADDRESSED_WEIGHT if kind == THREAT and not on else 1.0))


def pattern_of(symbol: tuple) -> tuple[int, ...] | None:
    """(kind, negated, reported, addressed) of a match."""
    return (symbol[0], *symbol[2:]) if MATCH in symbol else None


GRAMMAR = grammar()
#: Patterns in order, with their weight in the grammar; arcs as arrays by state and class.
PRIOR = {p: w for _, y, w in GRAMMAR.arcs.values() if (p := pattern_of(y))}
PATTERNS = sorted(PRIOR)
STEP = np.array([[GRAMMAR.arcs[s, x][0] for x in CLASSES] for s in range(GRAMMAR.states)])
EMIT = np.array([[PATTERNS.index(p) if (p := pattern_of(GRAMMAR.arcs[s, x][1])) else -1 for x in CLASSES] for s in range(GRAMMAR.states)])


def lower_case(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the capitals of ISO 8859-1 in lower case."""
    out = LOWER[data]
    mark = np.flatnonzero(data[:-1] == 0xC3) + 1
    mark = mark[(data[mark] >= 0x80) & (data[mark] <= 0x9E) & (data[mark] != 0x97)]
    out[mark] += 0x20
    return out


def word_hash(word_list: list[str]) -> np.ndarray:
    """Hashes of whole words, as `words` gives them."""
    raw = [w.encode() for w in word_list]
    if not raw:
        return np.zeros(0, np.uint64)
    c = Chunk(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))), None, 0)
    return words(c, np.ones(256, dtype=bool)).hash


class Lexicon:
    """Classes of words by hash; stems stand for all words that begin with them, the longest counts."""

    def __init__(self, stems: tuple[str, ...] = (), fixed: bool = True):
        self.words, cls = [], []
        if fixed:
            for group, c in ((TARGETS, TARGET), (NEGATORS, NEGATOR), (REPORTERS, REPORTER), (THREATS, THREAT), (INSULTS, INSULT)):
                fresh = [w for w in dict.fromkeys(group) if w not in self.words]
                self.words += fresh
                cls += [c] * len(fresh)
        self.whole = len(self.words)
        self.words += stems
        self.cls = np.array(cls + [INSULT] * len(stems), dtype=np.int64)
        h = word_hash(self.words)
        self.tables = [(0, *self._table(h, np.arange(self.whole)))] if fixed else []
        size = np.array([len(w.encode()) for w in self.words])
        for n in sorted(set(size[self.whole :].tolist())):
            self.tables.append((n, *self._table(h, self.whole + np.flatnonzero(size[self.whole :] == n))))

    @staticmethod
    def _table(h: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(h[which])
        return h[which][order], which[order]

    def find(self, c: Chunk, w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
        """(words, entries) that match, for whole words and then for each length of stems."""
        out = []
        size = w.end - w.start
        for n, table, entry in self.tables:
            if n:
                which = np.flatnonzero(size >= n)
                follow = c.data[np.minimum(w.start[which] + n, len(c.data) - 1)] if len(which) else np.zeros(0, np.uint8)
                which = which[(size[which] == n) | ((follow & 0xC0) != 0x80)]
                h = w.prefix_hash(which, n)
            else:
                which, h = np.arange(len(w.hash)), w.hash
            at = np.minimum(np.searchsorted(table, h), len(table) - 1)
            hit = table[at] == h
            out.append((which[hit], entry[at[hit]]))
        return out

    def matches(self, c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, clause, entry, pattern) of every match; clauses are numbered within the chunk."""
        w = words(c, ALNUM, lower_case(c.data), prefixes=True)
        at = np.full(len(w.hash), -1, dtype=np.int64)
        for which, entry in reversed(self.find(c, w)):
            free = at[which] < 0
            at[which[free]] = entry[free]
        cls = np.where(at >= 0, self.cls[at], OTHER)
        ends = np.concatenate(([0], np.cumsum(_ENDS[c.data])))
        clause = ends[w.start] + w.doc  # rises at each end of a clause or document
        hit = np.flatnonzero((cls == INSULT) | (cls == THREAT))
        got: list[tuple[int, int, int, int]] = []
        for name in np.unique(clause[hit]).tolist():
            a, b = np.searchsorted(clause, [name, name + 1])
            state = 0
            for k, kind in enumerate(cls[a:b].tolist(), int(a)):
                if (pattern := int(EMIT[state, kind])) >= 0:
                    got.append((int(w.doc[k]), name, int(at[k]), pattern))
                state = int(STEP[state, kind])
        x = np.array(got, dtype=np.int64).reshape(-1, 4)
        return x[:, 0], x[:, 1], x[:, 2], x[:, 3]


@dataclass
class Model:
    stems: tuple[str, ...]
    strength: np.ndarray
    factor: np.ndarray
    unmatched: float


def _stems(sample: DataFrame) -> tuple[str, ...]:
    """Stems that tell toxic documents of the sample (doc_id, text, label) from the others."""
    token = F.expr(r"filter(split(lower(text), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), x -> x <> '')")
    toxic = sample.where(F.col("text").isNotNull() & (F.col("label") == 1)).select("doc_id", token.alias("w"))
    each = toxic.select("doc_id", F.explode(F.arrays_zip("w", F.concat(F.array(F.lit("")), F.col("w")).alias("p"))).alias("x"))
    each = each.where(F.length("x.w") >= min(STEM_SIZES)).groupBy("doc_id", F.col("x.w").alias("w")).agg(F.min("x.p").alias("p"))
    sizes = F.sequence(F.lit(min(STEM_SIZES)), F.least(F.length("w"), F.lit(max(STEM_SIZES))))
    stem = each.select("doc_id", "p", F.explode(F.transform(sizes, lambda n: F.substring(F.col("w"), F.lit(1), n))).alias("stem"))
    seen = stem.groupBy("stem", "doc_id").agg(F.min("p").alias("p")).groupBy("stem").agg(F.count("*").alias("a"), F.approx_count_distinct("p").alias("k"))
    # at most the stems of MIN_DOCS documents of the bounded sample
    found = seen.where((F.col("a") >= MIN_DOCS) & (F.col("k") >= MIN_CONTEXTS)).select("stem").collect()
    candidates = tuple(sorted(r["stem"] for r in found))
    if not candidates:
        return ()
    lexicon = Lexicon(candidates, fixed=False)

    def run(batches):
        for batch in batches:
            y = np.array([int(v == 1) for v in batch.column(2).to_pylist()], dtype=np.int64)
            for c in chunks(batch.column(1)):
                w = words(c, ALNUM, lower_case(c.data), prefixes=True)
                parts = [np.unique(entry * c.n + w.doc[which]) for which, entry in lexicon.find(c, w)]
                pair = np.concatenate(parts) if parts else np.zeros(0, np.int64)
                n = np.bincount(pair // c.n, minlength=len(candidates))
                a = np.bincount(pair // c.n, weights=y[c.first + pair % c.n], minlength=len(candidates)).astype(np.int64)
                k = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(a[k]), pa.array(n[k])], names=["entry", "a", "n"])

    counts = sample.mapInArrow(run, "entry long, a long, n long").groupBy("entry").agg(F.sum("a").alias("a"), F.sum("n").alias("n")).collect()
    # one row of each kind for smoothing: a stem in few documents is not pure by chance
    pure = {candidates[r["entry"]]: r["a"] for r in counts if r["a"] >= MIN_DOCS and r["a"] >= MIN_PURITY * (r["n"] + 1)}
    return narrowed(pure)


def narrowed(pure: dict[str, int]) -> tuple[str, ...]:
    """Stems of MIN_STEM letters or more, and longer where one continuation stands for nearly all of a stem's documents.

    pure: stems and the toxic documents that they are in. A beginning of few letters says nothing of the words that a
    sample does not have, so it gives way to its continuations, and is not learned where it has none that is pure.
    """
    longer: dict[str, list[str]] = {}
    for stem in pure:
        if stem[:-1] in pure:
            longer.setdefault(stem[:-1], []).append(stem)
    out, left = set(), [s for s in pure if s[:-1] not in pure]
    while left:
        stem = left.pop()
        more = longer.get(stem, [])
        if len(stem) < MIN_STEM:
            left += more
        elif more and max(pure[m] for m in more) >= SPECIFIC * pure[stem]:
            left.append(max(more, key=lambda m: (pure[m], m)))
        elif len(stem) >= MIN_STEM:
            out.add(stem)
    return tuple(sorted(out))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_docs: int = MAX_FIT_DOCS) -> Model:
    """Model from a bounded sample of the labelled rows outside the held-out fold."""
    rows = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.where(F.col("label").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    # at most max_docs ids: a broadcast of a proven size
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    sample = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    # of rows of one id, one: the sample is bounded by rows as well
    sample = sample.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label").repartition(8)
    stems = _stems(sample)
    lexicon = Lexicon(stems)

    def run(batches):
        for batch in batches:
            y = np.array(batch.column(2).to_pylist())
            for c in chunks(batch.column(1)):
                doc, _, place, pattern = lexicon.matches(c)
                got = {(d, p, q) for d, p, q in zip(doc.tolist(), place.tolist(), pattern.tolist(), strict=True)}
                got |= {(d, -1, -1) for d in set(range(c.n)) - set(doc.tolist())}
                rows = sorted((p, q, int(y[c.first + d] == 1)) for d, p, q in got)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["place", "pattern", "label"])

    counts = sample.mapInArrow(run, "place long, pattern long, label long").groupBy("place", "pattern").agg(F.sum("label").alias("a"), F.count("*").alias("n")).collect()
    seen = np.zeros((len(lexicon.words), 2))
    by = np.zeros((len(PATTERNS), 2))
    none = np.zeros(2)
    for r in counts:
        if r["place"] < 0:
            none += (r["a"], r["n"])
        else:
            seen[r["place"]] += (r["a"], r["n"])
            by[r["pattern"]] += (r["a"], r["n"])
    prior = np.where(lexicon.cls == INSULT, 0.8, 0.4)
    strength = (seen[:, 0] + 2 * prior) / (seen[:, 1] + 2)
    base = (by[:, 0].sum() + 1) / (by[:, 1].sum() + 1)
    ten = np.array([PRIOR[p] for p in PATTERNS]) * base * 10
    factor = np.minimum(1, (by[:, 0] + ten) / (by[:, 1] + 10) / base)
    return Model(stems, strength, factor, float((none[0] + 0.01) / (none[1] + 1)))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a score from 0 to 1; a column of that name before is replaced."""
    keep = [c for c in docs.columns if c != out]
    lexicon = Lexicon(model.stems)

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for c in chunks(column):
                doc, clause, place, pattern = lexicon.matches(c)
                left = np.full(c.n, 1.0 - model.unmatched)
                # matches of a clause follow each other
                first = np.flatnonzero(np.concatenate(([True], clause[1:] != clause[:-1]))) if len(clause) else clause
                if len(first):
                    np.multiply.at(left, doc[first], 1 - np.maximum.reduceat(model.strength[place] * model.factor[pattern], first))
                rows = batch.slice(c.first, c.n)
                yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(k)) for k in keep] + [pa.array(1 - left)], names=[*keep, out])

    return docs.mapInArrow(run, T.StructType([f for f in docs.schema.fields if f.name != out] + [T.StructField(out, T.DoubleType())]))


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (score >= THRESHOLD)."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return score(plain, model).select(
        "doc_id",
        (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
