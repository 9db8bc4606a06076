"""Problem 6: missing or wrong document language labels."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import columns, spread
from corpusloom.llm.mojibake import Repairer, repaired
from corpusloom.llm.page import Classifier, Page
from corpusloom.llm.quality import Readable, is_row
from corpusloom.llm.residue import CANDIDATE, candidate_hashes, page_signs, recurring
from corpusloom.llm.spam import _DOT, _TARGET, FUNCTION_WORDS
from corpusloom.storage import checkpointed

LANGUAGES = ("de", "en", "es", "fr", "it")

#: Hashed features of a word.
FEATURES = 1 << 15

#: A line counts as foreign from so many words on, if so large a part of them is.
MIN_WORDS, MIN_SHARE = 8, 0.6

#: Of the words of such a line, so many are of letters; numbers and cells of tables say nothing.
MIN_LETTER_WORDS = 5

#: A text has a language if so large a part of its tokens with letters, by characters, is readable.
MIN_READABLE = 0.45

#: At most so many labelled samples and words are used for training; a bound, not a share of the input.
MAX_SAMPLES = 5_000

#: About so many labelled documents, those of least hash, widen the lexicon; when a word belongs to a language; and how many words
#: at most are taken, the most frequent ones.
MAX_LABELLED, LABEL_DOCS, LABEL_SHARE, MAX_WORDS = 3_000, 4, 0.75, 100_000

#: A named language stands against another one of so little more weight.
MARGIN = 0.1

_WORD = re.compile(r"[^\W\d_]+")
_CELL = re.compile(r"[\s;|]+")


class _Index(dict):
    """Hash of a feature by its name, kept in memory up to a bound."""

    BOUND = 400_000

    def __missing__(self, name: str) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        value = self[name] = xxhash.xxh32_intdigest(name) & (FEATURES - 1)
        return value


_index = _Index().__getitem__


def word_features(word: str, lexicon: dict[str, set[str]]) -> list[int]:
    """Hashed affixes, letter n-grams and lexicon entries of a word."""
    framed = f"^{word}$"
    n = len(framed)
    names = [f"w={word}", *(f"lex={lang}" for lang in sorted(lexicon.get(word, ())))]
    names += ["p=" + framed[:k] for k in (2, 3, 4)] + ["s=" + framed[-k:] for k in (2, 3, 4, 5)]
    names += {"g=" + framed[i : i + k] for k in (2, 3, 4) for i in range(n - k + 1)}
    return list(map(_index, names))


def forward_backward(emission: np.ndarray, mask: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (B, T, L), expected transitions (L, L) and log-likelihood normalisers (B,) of padded sequences, scaled at each word."""
    b, t, n = emission.shape
    top = emission.max(axis=2, keepdims=True)
    e = np.exp(emission - top)
    a, scale = np.empty_like(e), np.ones((b, t), e.dtype)
    move = np.exp(transition)
    current = np.exp(start) * e[:, 0]
    for i in range(t):
        if i:
            step = (current @ move) * e[:, i]
            current = np.where(mask[:, i, None], step, current)
        total = current.sum(axis=1)
        current = current / total[:, None]
        scale[:, i] = np.where(mask[:, i], total, 1.0)
        a[:, i] = current
    back = np.ones((b, n), e.dtype)
    out = np.empty_like(e)
    pairs = np.zeros((n, n))
    for i in range(t - 1, -1, -1):
        out[:, i] = a[:, i] * back
        if i:
            w = e[:, i] * back / scale[:, i, None]
            pairs += (a[:, i - 1] * mask[:, i, None]).T @ w * move
            back = np.where(mask[:, i, None], w @ move.T, back)
    out /= out.sum(axis=2, keepdims=True)
    log_z = (np.log(scale) * mask).sum(axis=1) + (top[:, :, 0] * mask).sum(axis=1)
    return out, pairs, log_z


class Tagger:
    """Linear-chain conditional random field over the words of a line."""

    def __init__(self, weights: np.ndarray, transition: np.ndarray, start: np.ndarray, lexicon: dict[str, set[str]]):
        self.weights, self.transition, self.start, self.lexicon = weights.astype(np.float32), transition.astype(np.float32), start.astype(np.float32), lexicon
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, len(LANGUAGES)), np.float32)
        self.waiting: list[list[int]] = []

    def ids(self, words: list[str]) -> list[int]:
        """Row of each word in the table of emissions, which grows with the words met and is dropped at a bound."""
        index = self.index
        try:
            return [index[w] for w in words]
        except KeyError:
            pass
        for w in words:
            if w not in index:
                self.waiting.append(word_features(w, self.lexicon))
                index[w] = len(index)
        return [index[w] for w in words]

    def _fill(self) -> None:
        """Emissions of the words met since the last time, all at once."""
        if not self.waiting:
            return
        sizes = np.array([len(f) for f in self.waiting])
        flat = np.concatenate([np.array(f) for f in self.waiting])
        made = np.add.reduceat(self.weights[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
        end = len(self.index)
        if end > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(end, len(self.rows)), len(LANGUAGES)), np.float32)])
        self.rows[end - len(made) : end] = made
        self.waiting = []

    def _marginals(self, lines: list[list[int]]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Numbers of lines of like length, the marginals of their words, and which places hold a word."""
        self._fill()
        order = sorted((i for i, x in enumerate(lines) if x), key=lambda i: len(lines[i]))
        at = 0
        while at < len(order):
            longest = len(lines[order[min(at + 511, len(order) - 1)]])
            take = max(1, min(512, 200_000 // max(1, longest)))
            part = order[at : at + take]
            at += take
            longest = len(lines[part[-1]])
            padded = np.zeros((len(part), longest), np.int64)
            mask = np.zeros((len(part), longest), bool)
            for r, i in enumerate(part):
                padded[r, : len(lines[i])] = lines[i]
                mask[r, : len(lines[i])] = True
            marginals, _, _ = forward_backward(self.rows[padded], mask, self.transition, self.start)
            yield part, marginals, mask

    def line_sums(self, lines: list[list[int]]) -> np.ndarray:
        """Sum of the marginals over the words of each line."""
        out = np.zeros((len(lines), len(LANGUAGES)), np.float32)
        for part, marginals, mask in self._marginals(lines):
            out[part] = (marginals * mask[:, :, None]).sum(axis=1)
        return out

    def line_runs(self, lines: list[list[int]]) -> tuple[np.ndarray, list[list[tuple[int, int, int, float]]]]:
        """The sums of :meth:`line_sums`, and for each line its runs of words of one most probable language:
        first and last word from 1, language, mean marginal of that language."""
        out = np.zeros((len(lines), len(LANGUAGES)), np.float32)
        runs: list[list[tuple[int, int, int, float]]] = [[] for _ in lines]
        for part, marginals, mask in self._marginals(lines):
            out[part] = (marginals * mask[:, :, None]).sum(axis=1)
            best = marginals.argmax(axis=2)
            for r, i in enumerate(part):
                n = len(lines[i])
                ends = [*(np.flatnonzero(np.diff(best[r, :n])) + 1).tolist(), n]
                for start, end in zip([0, *ends], ends, strict=False):
                    lang = int(best[r, start])
                    runs[i].append((start + 1, end, lang, float(marginals[r, start:end, lang].mean())))
        return out, runs

    def fresh(self) -> Tagger:
        return Tagger(self.weights, self.transition, self.start, self.lexicon)


def labelled_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", most: int = MAX_LABELLED) -> list[tuple[str, str]]:
    """(language, word) of words that stand almost only in documents of one label.

    Taken from a sample of about ``most`` labelled documents, those whose hash is below a bound that a count of rows
    gives.  Texts stay in their tasks, which add up the documents of each word and label; words that are decided
    reach the driver, at most MAX_WORDS.  Some labels are wrong, hence a word needs LABEL_SHARE of its
    documents, and at least LABEL_DOCS, in one language.
    """
    whole = 1 << 31
    below = min(whole, most * whole // max(1, docs.count()) + 1)
    own = columns(docs, id=id_col, text=text_col, label=label_col)
    own = own.where(f"pmod(xxhash64(id), {whole}L) < {below} AND text IS NOT NULL AND label IS NOT NULL AND id IS NOT NULL").select("text", "label")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], int] = {}
        for batch in batches:
            for text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lang = named_language(label)
                if lang is not None:
                    for word in set(_WORD.findall(_TARGET.sub(" ", text.lower()))):
                        counts[lang, word] = counts.get((lang, word), 0) + 1
        langs, words = zip(*counts, strict=True) if counts else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

    by_lang = own.mapInArrow(work, "lang string, word string, n bigint").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    words = by_lang.groupBy("word").agg(F.max_by("lang", F.struct("n", "lang")).alias("lang"), F.max("n").alias("n"), F.sum("n").alias("of"))
    decided = words.where(F.col("n") >= LABEL_DOCS).where(F.col("n") >= LABEL_SHARE * F.col("of"))
    return sorted(((r.lang, r.word) for r in decided.orderBy(F.desc("n"), "word").limit(MAX_WORDS).collect()), key=lambda x: x[1])


def train(
    samples: Iterable[tuple[str, str]], words: Iterable[tuple[str, str]], more_words: Iterable[tuple[str, str]] = (), rounds: int = 60, seed: int = 6
) -> Tagger:
    """Fit the field on labelled samples by gradient ascent of the penalised likelihood.

    Sequences are the samples themselves and as many code-switched ones made of
    stretches of two or three of them, from which transitions between languages are
    learned.  At most MAX_SAMPLES of each input are used.  ``more_words`` enter the lexicon
    alone, whose weight is learned from the samples.
    """
    rng = np.random.default_rng(seed)
    lexicon: dict[str, set[str]] = {}
    for lang, word in list(words)[:MAX_SAMPLES]:
        if word and lang in LANGUAGES:
            lexicon.setdefault(word.lower(), set()).add(lang)
    base = [([w for w in _WORD.findall(text.lower())], LANGUAGES.index(lang)) for lang, text in list(samples)[:MAX_SAMPLES] if text and lang in LANGUAGES]
    base = [(w, y) for w, y in base if w]
    base += [([w], LANGUAGES.index(lang)) for w, langs in sorted(lexicon.items()) if len(langs) == 1 for lang in langs]
    sequences = [(w, [y] * len(w)) for w, y in base]
    for _ in range(len(base)):
        seq: list[str] = []
        tags: list[int] = []
        for k in rng.integers(0, len(base), int(rng.integers(2, 4))):
            w, y = base[k]
            cut = w[: int(rng.integers(1, len(w) + 1))]
            seq += cut
            tags += [y] * len(cut)
        sequences.append((seq, tags))
    for lang, word in more_words:
        if lang in LANGUAGES:
            lexicon.setdefault(word.lower(), set()).add(lang)
    types = sorted({w for s, _ in sequences for w in s})
    at = {w: i for i, w in enumerate(types)}
    features = [word_features(w, lexicon) for w in types]
    flat = np.concatenate([np.array(f) for f in features])
    sizes = np.array([len(f) for f in features])
    starts, owner = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(types)), sizes)
    order = np.argsort(flat, kind="stable")  # occurrences by feature, to add up gradients without scattered writes
    used, firsts = np.unique(flat[order], return_index=True)
    longest = max(len(s) for s, _ in sequences)
    ids, gold, mask = (np.zeros((len(sequences), longest), k) for k in (np.int64, np.int64, bool))
    for r, (s, y) in enumerate(sequences):
        ids[r, : len(s)], gold[r, : len(s)], mask[r, : len(s)] = [at[w] for w in s], y, True
    n = len(LANGUAGES)
    weights, transition, start = np.zeros((FEATURES, n)), np.zeros((n, n)), np.zeros(n)
    target = np.zeros((len(types), n))
    np.add.at(target, (ids[mask], gold[mask]), 1.0)
    moves = np.zeros((n, n))
    both = mask[:, 1:]
    np.add.at(moves, (gold[:, :-1][both], gold[:, 1:][both]), 1.0)
    first = np.bincount(gold[:, 0], minlength=n).astype(float)
    state = [np.zeros_like(x) for x in (weights, transition, start)]
    at_word, at_tag = ids[mask], np.arange(n)
    for _ in range(rounds):
        emission = np.add.reduceat(weights[flat], starts, axis=0)
        marginals, pairs, _ = forward_backward(emission[ids], mask, transition, start)
        found = marginals[mask]
        expected = np.stack([np.bincount(at_word, found[:, k], len(types)) for k in at_tag], axis=1)
        gradient = np.zeros_like(weights)
        gradient[used] = np.add.reduceat((target - expected)[owner[order]], firsts, axis=0)
        for value, grad, memory, penalty in (
            (weights, gradient, state[0], 0.05), (transition, moves - pairs, state[1], 0.5), (start, first - marginals[:, 0].sum(axis=0), state[2], 0.5),
        ):
            grad = grad - penalty * value
            memory += grad * grad
            value += 0.25 * grad / np.sqrt(memory + 1e-8)
    return Tagger(weights, transition, start, lexicon)


def named_language(label: str | None) -> str | None:
    """Language a label names, without regard to case, spacing and region; None if it names none of the five."""
    code = re.split(r"[-_]", (label or "").strip().lower())[0]
    return code if code in LANGUAGES else None


def document_languages(
    docs: DataFrame,
    tagger: Tagger,
    sample: Iterable[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    title_col: str = "title",
    label_col: str = "lang",
    source_col: str = "source",
    without_residue: bool = False,
    stretches: bool = False,
) -> DataFrame:
    """(id, line_no, lang, confidence, named): language of each document and of each foreign line of its main body.

    ``line_no`` 0 is the document, whose language is the one of most words of the main
    body, or the named one where both are within MARGIN; a further row is given for every line of at least MIN_WORDS words in another
    language.  ``named`` is the language the label names.  Confidence is the share of the
    marginal probability, from forward-backward over each line.  Lines are tagged in
    batches within one narrow pass; the model has a fixed size.  Documents without
    readable text in the main body, null or empty ones and null ids give no row; repeated
    rows give repeated rows.  ``without_residue`` leaves out the cases of problem 2, whose
    signs are read off the same pages in the same pass.

    With ``stretches`` the rows are (id, line_no, start, end, lang, confidence, named), and in
    place of whole lines there is one for every run of words in another language than the
    main one, of whatever length and in whatever line of the main body; ``start`` and ``end`` are
    its first and last word, counted from 1 over the words of letters outside link targets,
    and null for the document.
    """
    texts = list(sample)
    shared = docs.sparkSession.sparkContext.broadcast(tagger.fresh())  # FEATURES x 5 floats and the word list

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of, repairer, readable, tag = Classifier(), Repairer(), Readable(texts), shared.value.fresh()
        for whole in batches:
            for start in range(0, whole.num_rows, 1_000):
                batch = whole.slice(start, 1_000)
                if len(tag.index) > 150_000:
                    tag = tag.fresh()
                heads, lines, numbers, candidates = [], [], [], []
                for key, text, title, label, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if key is None or not text:
                        continue
                    page = Page(repaired(text, repairer), title, kind_of)
                    if without_residue:
                        signs = page_signs(page)
                        if any(sign != CANDIDATE for sign, _ in signs):
                            continue
                        candidates += [(key, source, h) for h in candidate_hashes(signs)]
                    at = page.body()
                    body = [page.lines[i] for i in at]
                    if not _has_words("\n".join(body), readable):
                        continue
                    first = len(lines)
                    for i, line in zip(at, body, strict=True):
                        if _DOT.search(line):
                            line = _TARGET.sub(" ", line)
                        words = _WORD.findall(line.lower())
                        lines.append(tag.ids(words))
                        numbers.append((page.numbers[i], line.count(" ") + 1 if len(words) >= MIN_LETTER_WORDS and (not is_row(line) or _is_sentence(line)) else 0))
                    heads.append((key, label, first, len(lines)))
                sums, runs = tag.line_runs(lines) if stretches else (tag.line_sums(lines), None)
                yield _decide(heads, numbers, sums, candidates, runs)

    rows = spread(columns(docs, id=id_col, text=text_col, title=title_col, label=label_col, source=source_col))
    made = rows.mapInArrow(work, "id bigint, line_no int, lang string, confidence double, named string, source string, hash bigint, start int, end int")
    named = ["id", "line_no", *(["start", "end"] if stretches else []), "lang", "confidence", "named"]
    if not without_residue:
        return made.select(*named).withColumnRenamed("id", id_col)
    made = checkpointed(made)  # a few words a document, used three times
    cases = recurring(made.where("hash IS NOT NULL").select("id", "source", "hash"))
    return made.where("hash IS NULL").select(*named).join(cases, "id", "left_anti").withColumnRenamed("id", id_col)


_LETTERS = re.compile(r"[^\W\d_]{3}")


def _has_words(text: str, readable: Readable) -> bool:
    """Function words, or else enough readable ones among the tokens with letters; numbers and marks say nothing."""
    tokens = text.split()
    if sum(map(FUNCTION_WORDS.__contains__, tokens)) * 8 >= len(tokens) > 0:
        return True
    tokens = [t for t in _CELL.split(text) if _LETTERS.search(t)]
    known = sum(len(t) for t in tokens if readable(t))
    return known >= 12 and known >= MIN_READABLE * sum(map(len, tokens))


def _is_sentence(line: str) -> bool:
    """Prose in the shape of a row: parted by semicolons or wide spaces, but ended as a sentence."""
    return line.rstrip()[-1:] in (".", "!", "?") and "|" not in line and "\t" not in line


def _decide(
    heads: list[tuple], numbers: list[tuple[int, int]], sums: np.ndarray, candidates: list[tuple] = (), runs: list[list[tuple]] | None = None
) -> pa.RecordBatch:
    out: list[tuple] = [(key, -1, None, None, None, source, h, None, None) for key, source, h in candidates]
    for key, label, first, last in heads:
        total = sums[first:last].sum(axis=0)
        mass = float(total.sum())
        if mass <= 0:
            continue
        main = int(total.argmax())
        named = named_language(label)
        if named is not None and float(total[main] - total[LANGUAGES.index(named)]) < MARGIN * mass:
            main = LANGUAGES.index(named)
        out.append((key, 0, LANGUAGES[main], float(total[main]) / mass, named, None, None, None, None))
        for i in range(first, last):
            number, words = numbers[i]
            if runs is not None:
                out += [(key, number, LANGUAGES[lang], sure, named, None, None, start, end) for start, end, lang, sure in runs[i] if lang != main]
                continue
            best = int(sums[i].argmax())
            if words >= MIN_WORDS and best != main:
                share = float(sums[i, best] / sums[i].sum())
                if share >= MIN_SHARE:
                    out.append((key, number, LANGUAGES[best], share, named, None, None, None, None))
    types = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32()]
    cols = list(zip(*out, strict=True)) or [[]] * len(types)
    names = ["id", "line_no", "lang", "confidence", "named", "source", "hash", "start", "end"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def label_faults(languages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, line_no, lang): documents whose label is missing or wrong, and foreign lines."""
    return languages.where(F.expr("line_no > 0 OR named IS NULL OR named <> lang")).select(id_col, "line_no", "lang").distinct()
