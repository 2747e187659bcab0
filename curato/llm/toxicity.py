"""Toxicity by a weighted finite-state grammar over clauses.

Words have kinds: insult, threat, target, negation, report, from a lexicon, and stem, learned from labels. Five transducers
read the kinds of a clause one after another: negation turns an insult, stem or threat that follows it closely into a negated
one, reported speech one that follows a verb of saying into a reported one, target one that stands near a word for a person
into a directed one, and the insult and threat transducers write what is left as events. They are composed into one
deterministic machine, which runs over clauses that hold an insult, a stem or a threat. A document is scored by its counts of
events, through log-odds weights: a weight for the first, the second and the third event of a kind.

Weights start from priors and are fitted to labels by Newton's method. Words outside the lexicon are learned as weighted stems:
whole words, and beginnings that inflected words share and go on from, in any language, which toxic texts have far more often
than others. Support counts different texts, in which near copies share one vote; a stem must hold LEARN_LEAST votes, pass a
likelihood-ratio test that no stem out of millions passes by chance, and have at least a LEARN_SHARE of its word forms in toxic
texts. Stems and weights are fitted on at most about SAMPLE labelled documents, chosen by a hash of doc_id, so what the driver
sees has a bound; at most LEARN_MOST stems. Labels whose crc32(doc_id as text) mod 3 is 1 are never read.

Whole texts are read: all words are hashed in numpy and looked up at once.

Defined results: a null or empty text has no events and gets the score of a text without matches. A null doc_id is not held
out and trains nothing. Rows that repeat a doc_id are scored each by its own text, and train with the label of that doc_id
each; of several labels of a doc_id the largest counts, and of equal texts too. Without labels the priors hold. Other columns
are kept by score_texts(), whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curato.llm import shared

SAMPLE, LEARN_LEAST, LEARN_MOST, LEARN_SHARE, LEARN_CHANCE = 20_000, 6, 256, 0.6, 26.0
#: Code points of the shortest and the longest beginning, and of the longest word that is looked at.
STEM_LEAST, STEM_MOST, WORD_MOST = 3, 16, 40
CUT, COPY_SEEDS = 0.7, 4
#: Words after a negation, or between a target and an insult, that still count as close.
NEAR = 4

# The lexicon, by kind, in English, French, German and Spanish.
INSULTS = """idiot idiots idiotic stupid moron morons moronic imbecile dumb dumbass fool loser losers trash garbage scum filth vermin pathetic worthless useless
disgusting clown clowns pig pigs bastard bitch asshole jerk retard retarded freak creep degenerate parasite subhuman ugly coward crap
imbécile crétin crétine débile abruti abrutie connard connasse salaud salope ordure racaille minable pourriture
dummkopf trottel arschloch idiotin blödmann schwachkopf abschaum dreckskerl versager widerlich wertlos erbärmlich
idiota imbécil estúpido estúpida tonto basura escoria patético inútil asqueroso payaso cabrón gilipollas""".split()
THREATS = """kill murder destroy hurt stab shoot strangle hang burn rape beat crush punish tuer crever détruire frapper égorger töten umbringen
schlagen vernichten matar destruir golpear""".split()
TARGETS = """you your yours yourself u he she him her they them their people person guy man woman everyone vous toi votre ihr euch dich dir
usted ustedes ellos ellas""".split()
NEGATIONS = """not no never neither nor without don doesn isn aren wasn weren didn won can cannot hardly nicht kein keine keinen nie niemals jamais aucun
aucune rien nunca jamás tampoco""".split()
REPORTS = """said says say saying called calls wrote writes quoted quote claimed claims allegedly reported according accused dit écrit appelé sagte
sagt nannte schrieb dijo dice llamó escribió""".split()

KINDS = ("other", "insult", "threat", "target", "negation", "report", "end", "stem")
FAMILIES = ("insult", "stem", "threat")
#: Events of a family, directed ones among the plain ones too, and how many of them count.
CAPS = {"": 3, "directed_": 1, "negated_": 2, "reported_": 2}
EVENTS = tuple(f"{how}{family}" for family in FAMILIES for how in CAPS)
CAP = np.array([*CAPS.values()] * len(FAMILIES))
#: Prior weights of the first, second and third event of each kind and, last, of the constant; and how firmly they hold.
PRIOR = np.array([2.2, 1.0, 0.5, 1.0, 0.2, 0.1, 0.3, 0.1, 1.0, 1.5, 0.5, 0.3, 0.2, 0.1, 0.3, 0.1, 0.8, 0.4, 0.2, 2.5, 0.2, 0.1, 0.3, 0.1, -3.0])
PRIOR_SD = 2.0


class Transducer:
    """A deterministic machine: step(state, symbol) -> (state, symbols written); start is the first state."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def then(self, other: Transducer) -> Transducer:
        """Composition: what this one writes is read by the other."""

        def step(state, symbol):
            mine, theirs = state
            mine, middle = self.step(mine, symbol)
            out = []
            for m in middle:
                theirs, written = other.step(theirs, m)
                out += written
            return (mine, theirs), out

        return Transducer((self.start, other.start), step)


def closeness(marker: str, rename: dict[str, str], reach: int) -> Transducer:
    """Symbols that follow marker within reach symbols are renamed; the marker itself is dropped."""

    def step(left, symbol):
        if symbol == marker:
            return reach, []
        if symbol == "end":
            return 0, [symbol]
        return max(0, left - 1), [rename.get(symbol, symbol) if left else symbol]

    return Transducer(0, step)


def targeting() -> Transducer:
    """An insult or threat becomes directed if a target is close before it or close after it."""

    def step(state, symbol):
        left, held, age = state  # reach of the last target; a word that waits for a target; symbols since it
        if symbol == "end":
            return (0, "", 0), [*([held] if held else []), symbol]
        if symbol == "target":
            return (NEAR, "", 0), [f"directed_{held}"] if held else []
        out = []
        if symbol in FAMILIES:
            if held:
                out.append(held)
            if left:
                return (left - 1, "", 0), [*out, f"directed_{symbol}"]
            return (0, symbol, 0), out
        if held and age + 1 >= NEAR:
            out, held = [held], ""
        return (max(0, left - 1), held, age + 1 if held else 0), [*out, symbol]

    return Transducer((0, "", 0), step)


def writing(*names: str) -> Transducer:
    """Passes on everything; inside a clause, events of these kinds count up to three times."""

    def step(seen, symbol):
        if symbol == "end":
            return 0, [symbol]
        if symbol.removeprefix("directed_") in names:
            return min(seen + 1, 3), [symbol] if seen < 3 else []
        return seen, [symbol]

    return Transducer(0, step)


def grammar() -> Transducer:
    turned = lambda how: {f: f"{how}_{f}" for f in FAMILIES}
    return closeness("negation", turned("negated"), NEAR).then(closeness("report", turned("reported"), 99)).then(targeting()).then(writing("insult", "stem")).then(writing("threat"))


class Machine:
    """The composed transducer with its reachable arcs as a table, filled as clauses need them."""

    def __init__(self):
        self.made, self.arcs = grammar(), {}

    def run(self, symbols: list[int], counts: np.ndarray) -> None:
        state = self.made.start
        for x in symbols:
            if (arc := self.arcs.get((state, x))) is None:
                to, written = self.made.step(state, KINDS[x])
                # a directed insult is an insult too
                arc = self.arcs[state, x] = to, [EVENTS.index(e) for w in written for e in {w, w.removeprefix("directed_")} if e in EVENTS]
            state = arc[0]
            for e in arc[1]:
                counts[e] += 1


#: Letters: ASCII ones and all bytes of other characters.
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?;\n"]] = True
LETTERS = re.compile(r"[^\W\d_]+")


def lowered(raw: np.ndarray) -> np.ndarray:
    """Small letters of ASCII and Latin-1, the capitals of which are 0x80 to 0x9E behind a byte 0xC3."""
    out = shared.LOWER[raw]
    latin = np.flatnonzero(raw[:-1] == 0xC3) + 1
    latin = latin[(raw[latin] >= 0x80) & (raw[latin] <= 0x9E) & (raw[latin] != 0x97)]
    out[latin] += 32
    return out


class Lexicon:
    """Kinds of words by hash, and learned stems: "word" is that word, "begin-" every longer word that begins so."""

    def __init__(self, learned: list[str]):
        kinds: dict[str, int] = dict.fromkeys((w for w in learned if not w.endswith("-")), 7)
        for kind, words in ((5, REPORTS), (4, NEGATIONS), (3, TARGETS), (2, THREATS), (1, INSULTS)):
            kinds |= dict.fromkeys(words, kind)
        hashes, _ = shared.hashed_words(*shared.text_buffers(pa.array(list(kinds))), False, NO_LETTER)
        order = np.argsort(hashes)
        self.hashes, self.kinds = hashes[order], np.array(list(kinds.values()))[order]
        stems = [w[:-1].encode() for w in learned if w.endswith("-")]
        self.heads = np.zeros(1 << 16, bool)
        self.heads[[s[0] << 8 | s[1] for s in stems]] = True
        self.stems: dict[int, np.ndarray] = {}
        for n in sorted({len(s) for s in stems}):
            rows = np.frombuffer(b"".join(s for s in stems if len(s) == n), np.uint8).reshape(-1, n)
            self.stems[n] = np.sort(self._of_bytes(rows))

    @staticmethod
    def _of_bytes(rows: np.ndarray) -> np.ndarray:
        return shared.mix(((rows.astype(np.uint64) + np.uint64(1)) * shared.place_weights(rows.shape[1])).sum(axis=1, dtype=np.uint64))

    def kinds_of(self, raw: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kind of each word, 0 for others, and the byte at which it starts; raw is in small letters."""
        words, starts = shared.hashed_words(raw, inner, False, NO_LETTER)
        if not len(words):
            return np.zeros(0, np.int64), starts
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        kind = np.where(self.hashes[at] == words, self.kinds[at], 0)
        if self.stems:
            long = np.add.reduceat((~NO_LETTER[raw]).astype(np.int64), starts)
            maybe = np.flatnonzero((kind == 0) & (long > min(self.stems)))
            maybe = maybe[self.heads[raw[starts[maybe]].astype(np.int64) << 8 | raw[starts[maybe] + 1]]]
            for n, known in self.stems.items():
                own = maybe[long[maybe] > n]
                h = self._of_bytes(raw[starts[own][:, None] + np.arange(n)])
                kind[own[known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h]] = 7
        return kind, starts


def count_events(column: pa.Array, book: Lexicon, machine: Machine) -> np.ndarray:
    """Counts of EVENTS, up to CAP, of each text. A long text is read in pieces that end behind a stop, or else at a blank."""
    data, offsets = shared.text_buffers(column)
    out = np.zeros((len(offsets) - 1, len(EVENTS)), np.int64)
    for lo, hi in shared.blocks(offsets):
        whole, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        for a, b in shared.pieces(whole, STOP if hi - lo == 1 and STOP[whole].any() else NO_LETTER, 2 * shared.BLOCK_BYTES):
            raw, inner = lowered(whole[a:b]), np.clip(at - a, 0, b - a)
            kind, starts = book.kinds_of(raw, inner)
            hits = np.flatnonzero((kind == 1) | (kind == 2) | (kind == 7))
            if not len(hits):
                continue
            doc = np.searchsorted(inner, starts, "right") - 1
            clause = np.cumsum(STOP[raw])[starts]
            unit = np.r_[0, np.cumsum((np.diff(clause) > 0) | (np.diff(doc) > 0))]
            for u in np.unique(unit[hits]):
                x, y = np.searchsorted(unit, [u, u + 1])
                machine.run([*kind[x:y].tolist(), 6], out[lo + doc[x]])
    return np.minimum(out, CAP)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def events_of(docs: DataFrame, text: str, learned: list[str], to: str) -> DataFrame:
    """docs and an array column called to."""
    names, place = docs.columns, docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, book = Machine(), Lexicon(learned)
        for batch in batches:
            counts = count_events(batch.column(place).cast(pa.string()), book, machine)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts.tolist(), pa.list_(pa.int32()))], names=[*names, to])

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField(to, T.ArrayType(T.IntegerType()))]))


def told_texts(docs: DataFrame, labels: DataFrame, doc_id: str, text: str) -> DataFrame:
    """tid, toxic, text, vote: different texts of a sample of the labelled rows; near copies share one vote.

    Minimum hashes of a text's runs of five words, one for each of COPY_SEEDS, tell its near copies: nearly all of them have one.
    """
    told = labels.where(~held_out(labels["doc_id"])).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = told.count()
    some = told if n <= SAMPLE else told.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) < int((1 << 30) * SAMPLE / n))
    own = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    # about SAMPLE rows are broadcast, so texts stay where they are read
    texts = own.join(F.broadcast(some), "doc_id").withColumn("tid", F.xxhash64("text")).groupBy("tid").agg(F.max("toxic").cast("int").alias("toxic"), F.first("text").alias("text"))

    least_of = [f"m{j}" for j in range(COPY_SEEDS)]

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = shared.text_buffers(batch.column(2))
            mins = np.zeros((batch.num_rows, COPY_SEEDS), np.uint64)
            for lo, hi in shared.blocks(offsets):
                words, first = shared.word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], True)
                values, begin = shared.windows(words, first, 5, short=True)
                full = np.flatnonzero(np.diff(begin))
                for j in range(COPY_SEEDS if len(full) else 0):
                    mins[lo + full, j] = np.minimum.reduceat(shared.mix(values ^ shared.place_weights(j + 1)[j]), begin[full])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(mins[:, j].view(np.int64)) for j in range(COPY_SEEDS))], names=["tid", "toxic", "text", *least_of])

    kept = shared.keep(texts.mapInArrow(least, "tid long, toxic int, text string, " + ", ".join(f"{m} long" for m in least_of)), "told")
    # a row a text of the sample at most
    for m in least_of:
        kept = kept.join(F.broadcast(kept.groupBy(m).agg(F.count(F.lit(1)).alias(f"{m}_n"))), m)
    return kept.select("tid", "toxic", "text", (1 / F.greatest(*[F.col(f"{m}_n") for m in least_of])).alias("vote"))


def stems_of(text: str, known: set[str]) -> dict[str, int]:
    """How many different words of text, up to three, are a stem's."""
    out: dict[str, int] = {}
    for w in set(LETTERS.findall(text.lower())) - known:
        if STEM_LEAST <= len(w) <= WORD_MOST:
            for stem in (w, *(f"{w[:n]}-" for n in range(STEM_LEAST, min(len(w), STEM_MOST + 1)))):
                out[stem] = min(3, out.get(stem, 0) + 1)
    return out


def learn_stems(told: DataFrame) -> list[str]:
    """Words and beginnings ("begin-") outside the lexicon that toxic texts have far more often than others."""
    known = {*INSULTS, *THREATS, *TARGETS, *NEGATIONS, *REPORTS}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[float]] = {}

        def out() -> pa.RecordBatch:
            stems = list(sums)
            return pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), *(pa.array([sums[s][i] for s in stems], pa.float64()) for i in range(4))], names=["stem", "n", "t", "f", "tf"])

        for batch in batches:
            for toxic, text, vote in zip(*(batch.column(c).to_pylist() for c in ("toxic", "text", "vote")), strict=True):
                for stem, forms in stems_of(text or "", known).items():
                    s = sums.setdefault(stem, [0.0] * 4)
                    s[0] += vote
                    s[2] += vote * forms
                    if toxic:
                        s[1] += vote
                        s[3] += vote * forms
                if len(sums) > 200_000:
                    yield out()
                    sums.clear()
        if sums:
            yield out()

    all_n, all_t = told.agg(F.sum("vote"), F.sum(F.col("vote") * F.col("toxic"))).first()
    if not all_t or all_t >= all_n:
        return []
    sums = told.select("toxic", "text", "vote").mapInArrow(count, "stem string, n double, t double, f double, tf double").groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("n", "t", "f", "tf")])
    base = all_t / all_n
    entropy = lambda k, of, p: F.when(k > 1e-9, k * F.log(F.greatest(k, F.lit(1e-9)) / (of * p))).otherwise(0.0)
    ratio = 2 * (entropy(F.col("t"), F.col("n"), base) + entropy(F.col("n") - F.col("t"), F.col("n"), 1 - base))
    good = sums.where((F.col("t") >= LEARN_LEAST - 1e-6) & (F.col("tf") >= LEARN_SHARE * F.col("f")) & (F.col("t") > base * F.col("n"))).where(ratio >= LEARN_CHANCE)
    gain = F.col("tf") - 1.5 * (F.col("f") - F.col("tf"))
    # of stems that say the same the most specific one; nested ones follow one another, so the pool is larger than what is taken
    rows = good.select("stem", F.round(gain, 6).alias("gain")).orderBy(F.desc("gain"), F.desc(F.length("stem") + F.when(F.col("stem").endswith("-"), 0).otherwise(99)), "stem").limit(64 * LEARN_MOST).collect()
    out: list[str] = []
    for r in rows:
        stem = r["stem"].rstrip("-")
        if len(out) < LEARN_MOST and not any(stem.startswith(o.rstrip("-")) or o.startswith(stem) for o in out):
            out.append(r["stem"])
    return out


def steps(counts: np.ndarray) -> np.ndarray:
    """1 for each event of a kind that there is, first, second and so on, and 1 for the constant."""
    return np.concatenate([*[(counts[:, [e]] > np.arange(CAP[e])).astype(float) for e in range(len(CAP))], np.ones((len(counts), 1))], axis=1)


def fit(patterns: list[tuple[list[int], float, float]]) -> np.ndarray:
    """Weights of steps() from (counts, votes, toxic votes), by Newton's method on the posterior."""
    w = PRIOR.copy()
    if not patterns:
        return w
    x = steps(np.array([p[0] for p in patterns]))
    n, t = np.array([p[1] for p in patterns], float), np.array([p[2] for p in patterns], float)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (t - n * p) - (w - PRIOR) / PRIOR_SD**2
        # an event never speaks against toxicity: weights that would go below 0 rest there
        free = np.r_[(w[:-1] > 0) | (slope[:-1] > 0), True]
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / PRIOR_SD**2
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(curve[np.ix_(free, free)], slope[free])
        step *= min(1, 2 / max(1e-9, np.abs(step).max()))
        w, last = np.r_[np.maximum(w[:-1] + step[:-1], 0), w[-1] + step[-1]], w
        if np.abs(w - last).max() < 1e-9:
            break
    return w


class Model:
    def __init__(self, learned: list[str], weights: np.ndarray):
        self.learned, self.weights = learned, weights


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    told = shared.keep(told_texts(docs, labels, doc_id, text), "votes")
    learned = learn_stems(told)
    events = events_of(told.select("text", "toxic", "vote"), "text", learned, "events")
    # as many rows as kinds of counts
    rows = events.groupBy("events").agg(F.sum("vote").alias("n"), F.sum(F.col("vote") * F.col("toxic")).alias("t")).collect()
    return Model(learned, fit(sorted((list(r["events"]), r["n"], r["t"]) for r in rows)))


def score_texts(docs: DataFrame, model: Model, text: str = "text", events: str = "events", score: str = "score") -> DataFrame:
    """docs and the columns events (counts of EVENTS) and score."""
    found = events_of(docs, text, model.learned, events)
    total, at = F.lit(float(model.weights[-1])), 0
    for e, cap in enumerate(CAP):
        sums = np.r_[0, np.cumsum(model.weights[at : at + cap])]
        total, at = total + F.array(*[F.lit(float(x)) for x in sums])[F.col(f"`{events}`")[e]], at + cap
    return found.withColumn(score, 1 / (1 + F.exp(-total)))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = score_texts(docs.select("doc_id", docs["text"].cast("string").alias("text")), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that the model rejects."""
    events, score = shared.free_name(docs, "events"), shared.free_name(docs, "score")
    return score_texts(docs, train(docs, labels, doc_id, text), text, events, score).where(F.col(f"`{score}`") < CUT).select(*[F.col(f"`{c}`") for c in docs.columns])
