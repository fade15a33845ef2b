"""Toxicity by a weighted finite-state grammar over clauses, with a lexicon learned from labels."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import NOT_WORD, U64, byte_codes, flat, keys, mix, name, scattered, separators, spans
from ._shared import bounded_sample, keep, scratch, small_batches

#: Words of each class, in lower case; languages are not told apart.
INSULTS = "idiot idiots moron morons imbecile fool scum vermin loser losers trash garbage worthless pathetic disgusting stupid clown dumb idiota estúpido basura imbécil idiote stupide ordure abruti dummkopf abschaum trottel wertlos".split()
THREATS = "kill killed murder hurt destroy burn hang shoot stab beat töten umbringen tuer frapper matar golpear".split()
TARGETS = "you your yours he she they them him her people these those du dich ihr sie euch tu toi vous ils elles tú usted ustedes ellos".split()
NEGATIONS = "not never no neither nor without nicht kein keine nie pas jamais aucun nunca ningún sin".split()
REPORTS = "said says say called calls quoted wrote reported claims claimed according sagte schrieb laut dit écrit selon dijo escribió según".split()

#: Labels of words, as the grammar reads them.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = "oITYNR"
#: Between clauses.
STOPS = separators([(0x0A, 0x0A), (0x21, 0x21), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F)])
#: Bytes of the stems that are learned beside whole words.
STEMS = (4, 5, 6, 7, 8)


@dataclass
class Transducer:
    """Reads symbols and writes one for each. Without an arc, a symbol is copied and the state becomes `lapse` of it."""

    arcs: dict[tuple[int, str], tuple[int, str]]
    lapse: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.arcs.get((state, symbol)) or (self.lapse.get(state, state), symbol)


@dataclass
class Composed:
    """Transducers in a row, each reading what the one before writes; arcs are made when first needed."""

    parts: tuple[Transducer, ...]
    arcs: dict = field(default_factory=dict)

    def run(self, symbols: str) -> str:
        state, out = (0,) * len(self.parts), []
        for s in symbols:
            arc = self.arcs.get((state, s))
            if arc is None:
                after, x = [], s
                for part, q in zip(self.parts, state, strict=True):
                    q, x = part.step(q, x)
                    after.append(q)
                arc = self.arcs[state, s] = (tuple(after), x)
            state = arc[0]
            out.append(arc[1])
        return "".join(out)


def grammar() -> Composed:
    """The clause grammar. It writes, for each insult or threat, the sort of its use:

    I, T plain; K, V aimed at a target before it in the clause; i, t within four words after a negation;
    J, U in reported speech. Z is a target that follows an insult.
    """
    scope = range(1, 5)
    negation = Transducer(
        {(q, NEGATION): (4, NEGATION) for q in (0, *scope)} | {(q, INSULT): (q - 1, "i") for q in scope} | {(q, THREAT): (q - 1, "t") for q in scope},
        {q: q - 1 for q in scope},
    )
    reported = Transducer({(q, REPORT): (1, REPORT) for q in (0, 1)} | {(1, INSULT): (1, "J"), (1, THREAT): (1, "U"), (1, "i"): (1, "J"), (1, "t"): (1, "U")})
    aimed = Transducer({(0, TARGET): (1, TARGET), (1, INSULT): (1, "K"), (1, THREAT): (1, "V")})
    after = Transducer({(0, INSULT): (1, INSULT), (1, TARGET): (0, "Z"), (1, INSULT): (1, INSULT)})
    return Composed((negation, reported, aimed, after))


#: What a clause adds to a document's numbers, by sort.
SORTS = {"I": 0, "K": 1, "Z": 1, "i": 2, "J": 3, "T": 4, "V": 5, "t": 2, "U": 3}
NUMBERS = 8  # the sorts' weights; distinct entries; matched clauses


@dataclass
class Lexicon:
    """Weights of insult words, and of stems (all words that begin with them and are longer)."""

    words: dict[str, float]
    stems: dict[str, float]

    def __post_init__(self) -> None:
        rows = {name(w): (w, THREAT, 3.0) for w in THREATS}
        rows |= {name(w): (w, label, 0.0) for ws, label in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)) for w in ws}
        rows |= {name(w): (w, INSULT, x) for w, x in self.words.items()}
        self._hashes = np.array(sorted(rows), U64)
        self._rows = [rows[int(h)] for h in self._hashes]
        self._stems = {}
        for size in STEMS:
            own = {name(w): (w, x) for w, x in self.stems.items() if len(w.encode()) == size}
            if own:
                hashes = np.array(sorted(own), U64)
                self._stems[size] = hashes, [own[int(h)] for h in hashes]

    def find(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, list[tuple[str, str, float]]]:
        """Places (indices of words) that are in the lexicon, ascending, with entry, label and weight."""
        at = np.minimum(np.searchsorted(self._hashes, hashes), len(self._hashes) - 1)
        hit = np.flatnonzero(self._hashes[at] == hashes)
        found = dict(zip(hit.tolist(), [self._rows[i] for i in at[hit].tolist()], strict=True))
        codes = byte_codes(lower=True)
        for size, (known, entries) in self._stems.items():
            long = np.flatnonzero(lengths > size)
            value, places = np.zeros(len(long), U64), keys(size)
            for j in range(size):
                value += scattered(codes[buf[starts[long] + j]], places[j])
            value = mix(value)
            at = np.minimum(np.searchsorted(known, value), len(known) - 1)
            for i, k in zip(long[known[at] == value].tolist(), at[known[at] == value].tolist(), strict=True):
                if found.get(i, ("", OTHER, 0))[1] != INSULT:
                    found[i] = (entries[k][0], INSULT, entries[k][1])
        order = sorted(found)
        return np.array(order, np.int64), [found[i] for i in order]


def numbers(column: pa.Array, lexicon: Lexicon, machine: Composed) -> np.ndarray:
    """The NUMBERS of each row's text; clauses without an insult or threat add nothing."""
    buf, at = flat(column)
    out = np.zeros((len(column), NUMBERS))
    distinct = defaultdict(set)
    for starts, lengths, hashes in spans(column, NOT_WORD):
        place, entries = lexicon.find(buf, starts, lengths, hashes)
        if not any(e[1] in (INSULT, THREAT) for e in entries):
            continue
        low, high = int(starts[0]), int(starts[-1]) + 1
        rows = np.searchsorted(at, starts, "right") - 1
        # rows that are empty begin where the next one does
        clause = np.cumsum(STOPS[buf[low:high]])[starts - low] * np.int64(1) + rows.astype(np.int64) * (high - low + 1)
        groups = defaultdict(list)
        for i, e, c in zip(place.tolist(), entries, clause[place].tolist(), strict=True):
            groups[c].append((i, e))
        for members in groups.values():
            if not any(e[1] in (INSULT, THREAT) for _, e in members):
                continue
            row = int(rows[members[0][0]])
            # from a clause's first entry on; words between entries are copied as such
            symbols, last = [], members[0][0]
            for i, e in members:
                symbols.append(OTHER * min(i - last - 1, 8) + e[1] if i > last else e[1])
                last = i
            written = iter(x for x in machine.run("".join(symbols)) if x != OTHER)
            for (_, e), x in zip(members, written, strict=True):
                if x in SORTS:
                    out[row, SORTS[x]] += e[2] if x != "Z" else 1.0
                if e[1] in (INSULT, THREAT):
                    distinct[row].add(e[0])
            out[row, 7] += 1
    for row, own in distinct.items():
        out[row, 6] = len(own)
    return out


def inputs(x: np.ndarray) -> np.ndarray:
    """What the score sees: saturating, so that long texts don't count by length."""
    return np.concatenate((np.ones((len(x), 1)), np.log1p(np.maximum(x, 0)), (x[:, 6:7] >= 2).astype(float)), axis=1)


#: Coefficients without labels: distinct insults and their weights count, negated and reported ones less.
PRIOR = np.array([-4.0, 0.8, 0.9, 0.2, 0.2, 0.6, 1.0, 1.0, 0.3, 1.0])


@dataclass
class Model:
    lexicon: Lexicon
    coefficients: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-inputs(x) @ self.coefficients))


def logistic(x: np.ndarray, y: np.ndarray, pull: float = 1.0, steps: int = 40) -> np.ndarray:
    """Coefficients by Newton's method, pulled towards PRIOR."""
    w, z = PRIOR.copy(), inputs(x)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + pull * (w - PRIOR)
        move = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pull * np.eye(len(w)), gradient)
        w = w - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic) of the documents to learn from: those outside the held-out quarter, each text once, a bounded sample."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out("doc_id"))
    picked = bounded_sample(known, ["doc_id"], rows)
    return docs.select("doc_id", "text").where("text IS NOT NULL").join(picked, "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_lexicon(sample: DataFrame, entries: int, least: int) -> Lexicon:
    """Words and stems that mark toxic texts.

    Candidates are in `least` toxic texts or more, and 20 times as likely there as in others. They are
    taken greedily while one marks `least` texts that aren't marked twice yet: copies of a text bring
    many words, but need only few.
    """
    words = F.array_distinct(F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("[^\\x00-\\x60\\x7B-\\x7F]+"), F.lit(0)))
    rows = sample.select(F.xxhash64("text").alias("t"), "toxic", F.explode(words).alias("w"))
    total = dict(sample.groupBy("toxic").count().collect())
    bad, good = total.get(1, 0), total.get(0, 0)
    if not bad or not good:
        return Lexicon(dict.fromkeys(INSULTS, 3.0), {})
    # counts of whole words, and of stems by the texts that hold a longer word
    whole = rows.select("t", "toxic", "w", F.lit(0).alias("stem"))
    size = F.octet_length("w")
    stems = [rows.where(size > n).select("t", "toxic", F.substring(F.col("w").cast("binary"), 1, n).alias("b"), F.lit(1).alias("stem")) for n in STEMS]
    stems = reduce(DataFrame.unionByName, stems)
    # a stem must end with a whole character
    stems = stems.withColumn("w", F.col("b").cast("string")).where(F.is_valid_utf8("w")).select("t", "toxic", "w", "stem").distinct()
    every = whole.unionByName(stems)
    counts = every.groupBy("w", "stem").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where(F.col("a") >= least)
    odds = (F.col("a") + 0.5) / (bad + 1) / ((F.col("b") + 0.5) / (good + 1))
    chosen = counts.withColumn("odds", odds).where("odds >= 20").orderBy(F.desc("odds"), "stem", "w").limit(20 * entries).collect()
    marks = {(r.w, r.stem): float(np.log(r.odds)) for r in chosen}
    if not marks:
        return Lexicon(dict.fromkeys(INSULTS, 3.0), {})
    spark = sample.sparkSession
    table = spark.createDataFrame([(w, s) for w, s in marks], "w string, stem int")
    held = every.where("toxic = 1").join(F.broadcast(table), ["w", "stem"]).groupBy("w", "stem").agg(F.collect_set("t").alias("ts")).collect()
    texts = {(r.w, r.stem): set(r.ts) for r in held}
    marked, found = Counter(), {}
    while texts and len(found) < entries:
        gain = {k: sum(marked[t] < 2 for t in ts) * marks[k] for k, ts in texts.items()}
        best = max(gain, key=lambda k: (gain[k], -k[1], k[0]))
        if sum(marked[t] < 2 for t in texts[best]) < least:
            break
        found[best] = marks[best]
        marked.update(texts.pop(best))
    seeds = {w: 3.0 for w in INSULTS}
    return Lexicon(seeds | {w: x for (w, stem), x in found.items() if not stem}, {w: x for (w, stem), x in found.items() if stem})


def _measure(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = grammar()
        for batch in batches:
            x = numbers(batch.column(0), lexicon, machine)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    return run


def learn(docs: DataFrame, labels: DataFrame, *, rows: int = 20_000, entries: int = 400, least: int = 5) -> Model:
    """Fit lexicon and score on at most `rows` labelled documents, none of them held out.

    Without labels of both kinds, fixed words and coefficients are used.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sample = keep(labelled(docs, labels, rows), f"{scratch(spark, 'toxicity')}/sample")
    lexicon = learn_lexicon(sample, entries, least)
    found = sample.select("text", "toxic").mapInArrow(_measure(lexicon), "x array<double>, toxic int").collect()
    y = np.array([r.toxic for r in found], float)
    if not 0 < y.sum() < len(y):
        return Model(lexicon, PRIOR)
    return Model(lexicon, logistic(np.array([r.x for r in found]), y))


def _scorer(model, text: int, with_text: bool):
    """Each batch's columns (its text only on demand), with score and matched clauses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, own = grammar(), model.value
        for batch in batches:
            x = numbers(batch.column(text), own.lexicon, machine)
            stay = [i for i in range(batch.num_columns) if with_text or i != text]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in stay), pa.array(own.score(x)), pa.array(x[:, 7].astype(np.int64))],
                names=[*(batch.schema.names[i] for i in stay), "score", "clauses"],
            )

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **learning) -> DataFrame:
    """`docs` with all its columns, without the rows whose score reaches `threshold`; see `score`."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learn(docs, labels, **learning))
    small_batches(spark)
    names = [f"_{i}" for i in range(len(docs.columns))]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema, strict=True)]).add("score", "double").add("clauses", "long")
    found = docs.toDF(*names).mapInArrow(_scorer(model, docs.columns.index("text"), True), schema)
    return found.where(F.col("score") < threshold).select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def score(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **learning) -> DataFrame:
    """Scores of all whole texts of `docs` (doc_id, text): how likely `labels` (doc_id, toxic) would mark them.

    Each text is one scan without a shuffle. Words become labels of the grammar, its transducers say how
    each insult or threat is used in its clause, and a logistic score weighs the sorts of use. Only the text
    is an input. A null or empty text has the score of a text without matches; a null doc_id isn't held out;
    several labels of a document count as the highest; repeated rows are scored each; an empty table gives
    an empty result. Other columns are ignored.
    Returns doc_id, held_out, score, predicted, clauses (matched).
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, **learning))
    small_batches(docs.sparkSession)
    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scorer(model, 1, False), "doc_id long, score double, clauses long")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "clauses")
