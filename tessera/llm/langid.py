"""Operator 10: language identification by script ranges and a Viterbi path over words.

Learning: labelled documents outside the held-out fold; of each language a hash sample of about ``per_lang`` documents,
whose texts are counted whole. Counted are, for each language, hashed character features of its words (the word, its
trigrams and its first and last two letters, each with boundary marks) and the scripts of its letters.

Prediction: the script of a word's first letter narrows the candidates to languages that use it; each candidate scores the sum of
its features' log probabilities, clipped to ``CLIP`` below the best one. The best path through a text's words maximises the
sum of scores minus ``penalty`` for every change of language; its runs are the text's spans. The predicted language is that with
most letters in the path, ties to the smaller name. Its score is its share of all letters times its posterior: the softmax over languages of their
sums of scores over the square root of the number of words (neighbouring words are no independent witnesses). Words in a script that no
learned language uses count as letters but for no language.

Most texts stay in one language, and that is proved without walking the path: if no stretch of words favours another
language over the best single one by more than the penalty, no path with a change can win.

Nulls: a null text, or one without a letter, is ``und`` with score 0 and no spans. Documents with a null language are not learned from. If nothing can
be learned, every text is ``und``. A null doc_id counts as the empty id in the fold rule. Empty table: empty result.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from .common import id_remainder
from .worker import held, tidy

#: First and last code points of the letters of scripts: fixed values of the Unicode standard.
SCRIPTS = [
    (0x0041, 0x024F, "Latin"),
    (0x0250, 0x02FF, "Latin"),
    (0x0370, 0x03FF, "Greek"),
    (0x0400, 0x052F, "Cyrillic"),
    (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"),
    (0x0600, 0x077F, "Arabic"),
    (0x0900, 0x097F, "Devanagari"),
    (0x0980, 0x09FF, "Bengali"),
    (0x0B80, 0x0BFF, "Tamil"),
    (0x0E00, 0x0E7F, "Thai"),
    (0x10A0, 0x10FF, "Georgian"),
    (0x1100, 0x11FF, "Hangul"),
    (0x1E00, 0x1EFF, "Latin"),
    (0x1F00, 0x1FFF, "Greek"),
    (0x3040, 0x30FF, "Kana"),
    (0x3400, 0x4DBF, "Han"),
    (0x4E00, 0x9FFF, "Han"),
    (0xAC00, 0xD7AF, "Hangul"),
]
_STARTS = [a for a, _, _ in SCRIPTS]
LETTERS = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 14
CLIP = 8.0
#: A language uses a script that has this share of its letters.
SCRIPT_SHARE = 0.01


def script_of(letter: str) -> str:
    k = bisect_right(_STARTS, ord(letter)) - 1
    return SCRIPTS[k][2] if k >= 0 and ord(letter) <= SCRIPTS[k][1] else "other"


def letter_runs(text: str) -> list[str]:
    """Runs of letters; the pattern alone would take number signs such as fractions for letters."""
    return [r for r in LETTERS.findall(text) if r.isalpha() or any(map(str.isalpha, r))]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of lower-cased runs of letters: (all features, in the order of the words; where each word's begin).

    Long runs, as of scripts without spaces, have no feature of their own as a word.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    grams = (codes[:-2] * _MIX[0] + codes[1:-1] * _MIX[1] + codes[2:] * _MIX[2]) * _MIX[3] >> np.uint64(40)
    ends = np.cumsum(sizes + 2)
    own = np.ones(len(codes), bool)  # not the two positions at which the next word begins within a trigram
    own[ends - 1] = own[ends - 2] = False
    grams = grams[own[: len(grams)]]
    first = np.cumsum(sizes) - sizes
    # Behind its trigrams, each word has its first and last trigram once more, marked, and itself.
    whole = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) if len(w) <= 24 else 0 for w in words], np.uint64)
    more = np.stack([grams[first] * np.uint64(3) + np.uint64(1), grams[first + sizes - 1] * np.uint64(5) + np.uint64(2), whole], 1)
    out, starts = np.empty(len(grams) + 3 * len(words), np.uint64), first + 3 * np.arange(len(words))
    word = np.repeat(np.arange(len(words)), sizes)
    out[np.arange(len(grams)) + 3 * word] = grams
    for k in range(3):
        out[starts + sizes + k] = more[:, k]
    return (out % np.uint64(BUCKETS)).astype(np.int64), starts


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9], np.uint64)


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # buckets x languages
    scripts: dict[str, np.ndarray]  # script to a mask of languages

    def runs(self, runs: list[str]) -> np.ndarray:
        """A row of scores for each run of letters: 0 for its best language, below that for others; all 0 if no language uses its script."""
        if not runs:
            return np.zeros((0, len(self.langs)))
        buckets, starts = features([r.lower() for r in runs])
        s = np.add.reduceat(self.logp[buckets], starts, axis=0)
        names = [script_of(r[0]) for r in runs]
        used = {name: self.scripts.get(name, np.zeros(len(self.langs), bool)) for name in set(names)}
        mask = np.array([used[name] for name in names])
        best = np.where(mask, s, -np.inf).max(axis=1, keepdims=True)
        known = mask.any(axis=1)
        best[~known] = 0
        return np.where(known[:, None], np.where(mask, np.maximum(s, best - CLIP), best - CLIP) - best, 0.0)

    def known(self, piece: str) -> bool:
        return any(script_of(r[0]) in self.scripts for r in letter_runs(piece))


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Languages of the best path; ties stay in the language they are in, then go to the earlier one."""
    n, k = scores.shape
    best = int(scores.sum(axis=0).argmax())
    lead = np.cumsum(scores - scores[:, [best]], axis=0)
    lead = np.concatenate([np.zeros((1, k)), lead])
    if n == 0 or (lead - np.minimum.accumulate(lead, axis=0)).max() <= penalty:
        return np.full(n, best)
    back = np.empty((n, k), np.int16)
    here = scores[0].tolist()
    langs = range(k)
    for t, row in enumerate(scores[1:].tolist(), 1):
        top = max(here)
        at = here.index(top)
        top -= penalty
        for x in langs:
            back[t, x] = at if top > here[x] else x
        here = [(top if top > h else h) + r for h, r in zip(here, row, strict=True)]
    path = np.empty(n, np.int64)
    path[-1] = here.index(max(here))
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


#: Pieces that a worker remembers before it starts afresh, and characters of text that it labels at a time.
MEMORY, CHUNK = 200_000, 2_000_000


class Labeler:
    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty = model, penalty
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}  # of a piece: its row below, or -1 without letters
        self.scores, self.letters, self.silent = np.zeros((0, len(self.model.langs))), np.zeros(0, np.int64), np.zeros(0, bool)

    def learn(self, pieces: set[str]) -> None:
        new = pieces - self.number.keys()
        if len(self.number) + len(new) > MEMORY:
            self.forget()
            new = pieces
        found = [(p, r) for p in new if (r := [p] if p.isalpha() else letter_runs(p))]
        self.number.update(dict.fromkeys(new, -1))
        if not found:
            return
        self.number.update(zip([p for p, _ in found], range(len(self.letters), len(self.letters) + len(found)), strict=True))
        runs = list({x for _, r in found for x in r})
        of_run = dict(zip(runs, range(len(runs)), strict=True))
        rows, first = np.array([of_run[x] for _, r in found for x in r]), np.cumsum([0] + [len(r) for _, r in found[:-1]])
        scores = np.add.reduceat(self.model.runs(runs)[rows], first, axis=0)
        silent = ~scores.any(axis=1)  # all languages alike: of no script that is known, perhaps
        silent[silent] = [not self.model.known(found[k][0]) for k in np.flatnonzero(silent).tolist()]
        self.scores = np.concatenate([self.scores, scores])
        self.letters = np.concatenate([self.letters, [sum(map(len, r)) for _, r in found]])
        self.silent = np.concatenate([self.silent, silent])

    def path(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of learned pieces: (positions of those with letters, their language numbers or -1, their letters, the languages' sums of scores)."""
        rows = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        at = np.flatnonzero(rows >= 0)
        rows = rows[at]
        scores = self.scores[rows]
        path = viterbi(scores, self.penalty) if len(rows) else rows
        path[self.silent[rows]] = -1
        return at, path, self.letters[rows], scores.sum(axis=0)

    def label(self, texts: list[str | None], spans: bool = False) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, score, spans if asked for) of each text."""
        out: list[tuple[str, float, list]] = []
        start = 0
        while start < len(texts):
            stop, held = start, 0
            while stop < len(texts) and held < CHUNK:
                held += len(texts[stop] or "")
                stop += 1
            some = [t or "" for t in texts[start:stop]]
            split = [t.split() for t in some]
            start = stop
            if not self.model.langs:
                out += [("und", 0.0, [])] * len(split)
                continue
            self.learn({p for ps in split for p in ps})
            for text, pieces in zip(some, split, strict=True):
                at, path, letters, sums = self.path(pieces)
                if not len(path):
                    out.append(("und", 0.0, []))
                    continue
                votes = np.bincount(path[path >= 0], weights=letters[path >= 0], minlength=len(self.model.langs))
                best = int(votes.argmax())
                odds = sums / np.sqrt(len(path))
                score = float(votes[best] / letters.sum() / np.exp(odds - odds[best]).sum())
                out.append((self.model.langs[best], score, self.runs_of(text, pieces, at, path) if spans else []))
        return out

    def runs_of(self, text: str, pieces: list[str], at: np.ndarray, path: np.ndarray) -> list[tuple[int, int, str]]:
        """(start, end, language) of the runs of one language, in characters."""
        name = lambda k: self.model.langs[k] if k >= 0 else "und"
        if (path == path[0]).all():  # pieces before the first and behind the last have no letters, and so hold neither
            return [(text.index(pieces[at[0]]), text.rindex(pieces[at[-1]]) + len(pieces[at[-1]]), name(path[0]))]
        out: list[tuple[int, int, str]] = []
        behind, langs = 0, dict(zip(at.tolist(), path.tolist(), strict=True))
        for i, p in enumerate(pieces):
            begin = text.index(p, behind)
            behind = begin + len(p)
            if i not in langs:
                continue
            lang = name(langs[i])
            if out and out[-1][2] == lang:
                out[-1] = (out[-1][0], behind, lang)
            else:
                out.append((begin, behind, lang))
        return out

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        return self.label([text], spans=True)[0][2]


def labeler_of(sent, penalty: float) -> Labeler:
    """This worker's labeler for a broadcast model: what it remembers serves all tasks that the worker runs."""
    return held(f"labeler {penalty}", sent.value, lambda: Labeler(sent.value, penalty))


def fit(docs: DataFrame, modulus: int = 4, held_out: int = 2, per_lang: int = 3000, alpha: float = 0.3, most_langs: int = 256) -> Model:
    """Learns from a hash sample of about ``per_lang`` labelled documents of each of the ``most_langs`` languages with most documents, all outside the held-out fold.

    What reaches the driver is one row for each language and feature bucket, and for each language and script.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_remainder(F.col("doc_id"), modulus) != held_out))
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs)
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("langid")), F.lit(1 << 20)) / float(1 << 20)
    sample = known.select("doc_id", "text", "lang").join(F.broadcast(sizes), "lang").filter(draw < F.lit(float(per_lang)) / F.col("count"))

    def count(batches):
        words: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(letter_runs(text.lower()))
        out = []
        for lang, seen in words.items():
            counts, scripts = np.zeros(BUCKETS, np.int64), Counter()
            buckets, starts = features(list(seen)) if seen else (np.empty(0, np.int64), np.empty(0, np.int64))
            times = np.repeat(np.array(list(seen.values()), np.int64), np.diff(np.append(starts, len(buckets))))
            counts += np.bincount(buckets, weights=times, minlength=BUCKETS).astype(np.int64)
            for w, n in seen.items():
                scripts[script_of(w[0])] += n * len(w)
            out += [(lang, f, "", int(counts[f])) for f in np.flatnonzero(counts).tolist()] + [(lang, -1, s, n) for s, n in scripts.items()]
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "bucket", "script", "n"])

    counted = sample.select("lang", "text").mapInArrow(tidy(count), "lang string, bucket int, script string, n bigint").groupBy("lang", "bucket", "script").agg(F.sum("n").alias("n")).toArrow()
    names, bucket, n = counted.column("lang").to_pylist(), counted.column("bucket").to_numpy(), counted.column("n").to_numpy()
    langs = sorted(set(names))
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), {})
    number = {name: i for i, name in enumerate(langs)}
    lang = np.array([number[x] for x in names])
    grams = bucket >= 0
    table = np.full((len(langs), BUCKETS), alpha)
    table[lang[grams], bucket[grams]] += n[grams]
    masks: dict[str, np.ndarray] = {}
    letters = np.bincount(lang[~grams], weights=n[~grams], minlength=len(langs))
    for at in np.flatnonzero(~grams).tolist():
        if n[at] >= SCRIPT_SHARE * letters[lang[at]]:
            masks.setdefault(counted.column("script")[at].as_py(), np.zeros(len(langs), bool))[lang[at]] = True
    return Model(langs, np.ascontiguousarray(np.log(table / table.sum(axis=1, keepdims=True)).T), masks)


def identify(docs: DataFrame, model: Model, penalty: float = 12.0, spans: bool = False, names: tuple[str, str, str] = ("lang_pred", "score", "spans")) -> DataFrame:
    """Adds the columns ``names`` (the last with ``spans``) to docs (text), in place of columns of these names; whole texts, one narrow pass."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = names if spans else names[:2]
    docs = docs.drop(*names)
    at = docs.columns.index("text")

    def run(batches):
        labeler = labeler_of(sent, penalty)
        for b in batches:
            texts = b.column(at).to_pylist()
            found = labeler.label(texts, spans)
            more = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            if spans:
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
                more.append(pa.array([[dict(zip(("start", "end", "lang"), s, strict=True)) for s in f[2]] for f in found], kind))
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, *names])

    schema = StructType(list(docs.schema.fields)).add(names[0], StringType()).add(names[1], DoubleType())
    if spans:
        schema.add(names[2], ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType()).add("lang", StringType())))
    return docs.mapInArrow(tidy(run), schema)
