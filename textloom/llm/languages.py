"""Problem 7: the language of each document and of each stretch of a mixed one, with a confidence.

Segmentation-marginalised unigrams: each language has a probability for every piece of a fixed public
vocabulary, and a word's likelihood is the sum over all ways to segment it into pieces, by the forward
algorithm. The probabilities are fitted to the labelled samples by expectation-maximisation over the
same lattice. Sentences are scored by their words, and a Viterbi path over a text's sentences, with a
price on changing the language, gives its stretches.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.packing import TOKENIZERS
from textloom.util import clashless, spread

#: The languages and the spellings of their labels, without region and in lower case.
LANGUAGES = {
    "en": ["en", "eng", "english"],
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano"],
    "it": ["it", "ita", "italian", "italiano"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
    "nl": ["nl", "nld", "dut", "dutch", "nederlands"],
    "pl": ["pl", "pol", "polish", "polski"],
    "ru": ["ru", "rus", "russian", "русский"],
}

#: Price, in nats, of a change of language between sentences.
SWITCH = 7.0
#: Least words of a whole sentence with a full stop or a question mark, and of any other; words from which a bracketed text without a sentence's end is one.
WHOLE_SENTENCE, UNCLOSED, ASIDE = 3, 4, 6
#: Weight of the language-independent prior of a piece, in counts; rounds of expectation-maximisation.
PRIOR, ROUNDS = 60.0, 4
#: Rows of labelled samples read at most; the table is fixed and far smaller.
SAMPLE_ROWS = 50_000
#: Labelled documents that may join the training.
DOCUMENT_ROWS = 5_000
#: Texts of fewer characters have no label of their own.
SHORT = 45

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}'’]*")
_SENTENCE = regex.compile(r"[^.!?…\n]+[.!?…]*\s*|[.!?…\n]+\s*")
_TAG = regex.compile(r"<[^<>]{1,200}>|&[a-z]+;|https?://\S+|\[/?[a-z]+\]")
_BRACKETS = regex.compile(r"\([^()]*\)|\[[^\[\]]*\]")
_END = regex.compile(r"[.!?…](?=[^\p{L}\p{N}]|$)")
_CLOSED = regex.compile(r"[.?…][^\p{L}\p{N}!]*$")
_HIDDEN = regex.compile(r"\p{Cf}")


def plain_words(text: str) -> list[str]:
    """The words that tell a language: of letters, in lower case, without markup, widths and hidden characters."""
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    return _WORD.findall((_TAG.sub(" ", text) if "<" in text or "&" in text or "/" in text or "[" in text else text).lower())


def sentences(text: str) -> list[tuple[int, int, int, list[str]]]:
    """(start, end, words that count, words) of the sentences of a text that hold a word.

    A bracketed text is a sentence of its own, or several, if it holds a sentence's end or ASIDE words; else it
    is an aside: part of the sentence it stands in or follows, without counting for it. Fewer than UNCLOSED words
    count only if a full stop or question mark ends them. The sentences together hold every word of the text.
    """
    parts, shown, at = [], text, 0
    if "(" in text or "[" in text:
        for m in _BRACKETS.finditer(text):
            inner = m.group()[1:-1]
            n = len(plain_words(inner))
            if n >= ASIDE or (n >= WHOLE_SENTENCE and _END.search(inner)):
                parts += [(at, m.start()), (m.start(), m.end())]
                at = m.end()
            elif n:
                shown = shown[: m.start()] + " " * (m.end() - m.start()) + shown[m.end() :]
    out: list[tuple[int, int, int, list[str]]] = []
    held = None  # where asides begin that no sentence stands before
    for a, b in (*parts, (at, len(text))):
        for m in _SENTENCE.finditer(shown, a, b):
            words = plain_words(m.group())
            start, end = m.span()
            if n := len(words):
                if n < UNCLOSED and not _CLOSED.search(m.group()):
                    n = 0
                if held is not None:
                    start, held = held, None
                if shown is not text:
                    words = plain_words(text[start:end])
                out.append((start, end, n, words))
            elif shown is not text and _WORD.search(text, start, end):
                if out:
                    start, _, n, words = out[-1]
                    out[-1] = (start, end, n, plain_words(text[start:end]))
                elif held is None:
                    held = start
    if held is not None:
        out.append((held, len(text), 0, plain_words(text[held:])))
    return out


class PieceModel:
    """Unigram models of the pieces of one public vocabulary, one per language."""

    def __init__(self, pieces: Iterable[str], langs: Iterable[str] = LANGUAGES):
        self.langs = list(langs)
        self.ids = {p: k for k, p in enumerate(dict.fromkeys(pieces))}
        self.longest = max(map(len, self.ids), default=1)
        self.prob = np.full((len(self.ids) + 1, len(self.langs)), 1.0 / (len(self.ids) + 1))
        self.unknown = len(self.ids)
        #: What the log-likelihoods of a text are divided by for its confidence, as its words are not independent.
        self.temperature = 1.0
        # Words met so far, each with a row of log-likelihoods.
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.langs)))

    def lattice(self, word: str) -> list[tuple[int, int, int]]:
        """(end, start, piece) of all pieces in a word, by their end. A character that no piece holds is the unknown one."""
        text, get = "▁" + word, self.ids.get
        arcs = []
        for j in range(1, len(text) + 1):
            arcs += [(j, i, k) for i in range(max(0, j - self.longest), j) if (k := get(text[i:j])) is not None]
            if not arcs or arcs[-1][:2] != (j, j - 1):
                arcs.append((j, j - 1, self.unknown))
        return arcs

    def arcs(self, words: list[str]) -> list[np.ndarray]:
        """For each end from 1, the arcs of all words that end there, as rows of (word, start, piece)."""
        flat = np.array([(j, w, i, k) for w, word in enumerate(words) for j, i, k in self.lattice(word)], np.int64).reshape(-1, 4)
        flat = flat[np.argsort(flat[:, 0], kind="stable")]
        ends = np.arange(1, max(map(len, words), default=0) + 2)
        return [flat[a:b, 1:] for a, b in zip(np.searchsorted(flat[:, 0], ends), np.searchsorted(flat[:, 0], ends, side="right"), strict=True)]

    def forward(self, arcs: list[np.ndarray], words: int, scaled: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Sums over all segmentations up to each position of each word, all words at once: scaled sums, and the logarithms of their scales at the words' ends."""
        alpha = np.zeros((words, len(arcs) + 1, len(self.langs)))
        alpha[:, 0] = 1.0
        scale = np.zeros((words, len(self.langs)))
        for j, part in enumerate(arcs, 1):
            if not len(part):
                continue
            w, i, k = part.T
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            alpha[w[first], j] = np.add.reduceat(alpha[w, i] * self.prob[k], first, axis=0)
            if scaled and j % 16 == 0:
                # Long words would fall below the smallest number; all positions still looked back at are scaled alike.
                window = slice(max(0, j - self.longest), j + 1)
                top = np.maximum(alpha[w[first], window].max(axis=1), 1e-300)
                alpha[w[first], window] /= top[:, None]
                scale[w[first]] += np.log(top)
        return alpha, scale

    def train(self, samples: Iterable[tuple[str, str]]) -> PieceModel:
        """Fits the probabilities to (language, sentence) pairs."""
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(self.langs)))
        for lang, text in samples:
            if lang in self.langs:
                for w in plain_words(text):
                    counts[w][self.langs.index(lang)] += 1
        # Words of about one length are fitted together; one of more than 60 letters tells too little to be fitted to.
        by_length: dict[int, list[str]] = defaultdict(list)
        for w in counts:
            if len(w) <= 60:
                by_length[len(w) // 8].append(w)
        groups = [(self.arcs(ws), np.stack([counts[w] for w in ws]), np.array([len(w) for w in ws]) + 1) for ws in by_length.values()]
        for _ in range(ROUNDS):
            expected = np.zeros_like(self.prob)
            for arcs, n, ends in groups:
                alpha, _ = self.forward(arcs, len(n), scaled=False)
                beta = np.zeros_like(alpha)
                here = np.arange(len(n))
                beta[here, ends] = n / np.maximum(alpha[here, ends], 1e-300)
                for j in range(len(arcs), 0, -1):
                    w, i, k = arcs[j - 1].T
                    flow = self.prob[k] * beta[w, j]
                    np.add.at(beta, (w, i), flow)
                    np.add.at(expected, k, flow * alpha[w, i])
            # The prior is what all languages together make of a piece, mixed with a uniform one.
            shared = (expected / np.maximum(expected.sum(axis=0), 1e-9)).mean(axis=1, keepdims=True)
            prior = 0.5 * shared + 0.5 / len(self.prob)
            self.prob = (expected + PRIOR * prior) / (expected.sum(axis=0) + PRIOR)
        self.known.clear()
        return self

    def calibrate(self, samples: Iterable[tuple[str, str]], others: PieceModel) -> PieceModel:
        """Takes the temperature that makes another model's confidence in sentences it was not trained on, and in their beginnings, most honest."""
        totals, of = [], []
        for lang, text in samples:
            w = plain_words(text)
            for n in {min(len(w), m) for m in (3, 5, len(w))} if lang in self.langs and w else ():
                others.learn(w)
                totals.append(sum(others.score(x) for x in w[:n]))
                of.append(self.langs.index(lang))
        if totals:
            logits, right = np.stack(totals), np.arange(len(of))
            logits -= logits.max(axis=1, keepdims=True)
            self.temperature = min((float(t) for t in np.geomspace(0.5, 20, 60)), key=lambda t: -float((logits[right, of] / t - np.log(np.exp(logits / t).sum(axis=1))).mean()))
        return self

    def learn(self, words: Iterable[str]) -> None:
        """Adds the rows of words not met before: short ones together, each longer one by itself."""
        new = sorted({w for w in words if w not in self.known}, key=len)
        at = 0
        while at < len(new):
            # What a group takes is bounded by its longest word.
            to = at + 1
            while to < len(new) and (to - at) * (len(new[to]) + 1) < 200_000:
                to += 1
            part, at = new[at:to], to
            alpha, scale = self.forward(self.arcs(part), len(part))
            got = np.log(np.maximum(alpha[np.arange(len(part)), [len(w) + 1 for w in part]], 1e-300)) + scale
            first = len(self.known)
            while first + len(part) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[first : first + len(part)] = got
            self.known.update((w, first + k) for k, w in enumerate(part))

    def score(self, word: str) -> np.ndarray:
        """Log-likelihood of a word in each language."""
        if word not in self.known:
            self.learn([word])
        return self.rows[self.known[word]]

    def stretches(self, text: str) -> list[tuple[int, int, str, float, int, int]]:
        """(start, end, language, confidence, words, longest whole sentence in words) of the stretches of a text, in order."""
        return self.stretches_of([text])[0]

    def stretches_of(self, texts: list[str], most: int = 200_000) -> list[list[tuple[int, int, str, float, int, int]]]:
        """The stretches of each of some texts, whose new words are scored together; words met are forgotten once there are too many."""
        if len(self.known) > most:
            self.known.clear()
        parted = [[x for x in sentences(t) if x[3]] for t in texts]
        self.learn(w for spans in parted for *_, words in spans for w in words)
        lengths = [len(words) for spans in parted for *_, words in spans]
        if not lengths:
            return [[] for _ in texts]
        known = self.known
        at = np.fromiter((known[w] for spans in parted for *_, words in spans for w in words), np.int64)
        # One row a sentence, the sentences of all texts after one another.
        emit = np.add.reduceat(self.rows[at], np.cumsum([0, *lengths[:-1]]), axis=0)
        likeliest = emit.argmax(axis=1)
        out, k = [], 0
        for text, spans in zip(texts, parted, strict=True):
            here = slice(k, k := k + len(spans))
            out.append(self._stretches(text, spans, emit[here], likeliest[here]) if spans else [])
        return out

    def _stretches(self, text: str, spans: list, emit: np.ndarray, likeliest: np.ndarray) -> list[tuple[int, int, str, float, int, int]]:
        if (likeliest == likeliest[0]).all():
            path = likeliest.tolist()
        else:
            # A whole sentence can change the language; a few words would have to outweigh the price twice.
            best, back = emit[0].copy(), []
            for row in emit[1:]:
                top = int(best.argmax())
                stay = best >= best[top] - SWITCH
                back.append(np.where(stay, np.arange(len(best)), top))
                best = np.where(stay, best, best[top] - SWITCH) + row
            path = [int(best.argmax())]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            path.reverse()
        out = []
        k = 0
        while k < len(path):
            to = k
            while to < len(path) and path[to] == path[k]:
                to += 1
            total = emit[k:to].sum(axis=0)
            odds = np.exp((total - total.max()) / self.temperature)
            out.append((spans[k][0] if k else 0, spans[to][0] if to < len(path) else len(text), self.langs[path[k]], float(odds[path[k]] / odds.sum()), sum(len(x[3]) for x in spans[k:to]), max(x[2] for x in spans[k:to])))
            k = to
        return out


def vocabulary(tokenizers: str = TOKENIZERS) -> list[str]:
    """Lower-case pieces of letters of the public vocabulary, byte pieces and marks left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=f"{tokenizers}/piece_bpe_32k.model")
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_byte(k) or model.is_unknown(k))]
    return sorted({p.lower() for p in pieces if all(c == "▁" or c.isalpha() or c in "'’" for c in p)})


def train_languages(samples: DataFrame, docs: DataFrame | None = None, tokenizers: str = TOKENIZERS, rows: int = DOCUMENT_ROWS) -> PieceModel:
    """The model, from labelled sentences and, if given, labelled documents.

    Of the sentences (columns ``lang`` and ``text``; a fixed table) at most SAMPLE_ROWS are read. Of the
    documents a sample of at most ``rows``, drawn by a hash of the id, is read; those join the training
    that a first model puts into the one language their label names, with high confidence.
    """
    given = [(r[0], r[1]) for r in samples.where("lang is not null and text is not null").select("lang", "text").limit(SAMPLE_ROWS).collect()]
    pieces = vocabulary(tokenizers)
    model = PieceModel(pieces).train(given)
    held_out = sorted(given)[::2]
    halves = PieceModel(pieces).train(sorted(given)[1::2])
    if docs is None:
        return model.calibrate(held_out, halves)
    held = docs.where("text <> ''").select("doc_id", label_code("lang").alias("code"), "text").where("code is not null")
    total = docs.count()
    if total > rows:
        held = held.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * rows / total))
    labelled = held.limit(rows).select("code", "text").collect()
    for (code, text), of in zip(labelled, model.stretches_of([r[1] for r in labelled]), strict=True):
        if len(of) == 1 and of[0][2] == code and of[0][3] > 0.99:
            given.append((code, text))
    return PieceModel(pieces).train(given).calibrate(held_out, halves)


STRETCHES = "doc_id bigint, label string, n_chars bigint, stretch_no int, start int, end int, lang string, confidence double, n_words int, longest int"


def language_stretches(docs: DataFrame, samples: DataFrame, tokenizers: str = TOKENIZERS, model: PieceModel | None = None) -> DataFrame:
    """The stretches of each document: where, in which language, with what confidence, of how many words.

    ``label`` is the label given; ``n_chars`` counts the text. Null ids and null texts, and texts
    without a word, give no row; a document that stands there several times gives its rows each time.
    """
    return _per_document(docs, samples, tokenizers, model, lambda i, label, text, found: [(i, label, len(text), k, *s) for k, s in enumerate(found)], STRETCHES)


def _per_document(docs: DataFrame, samples: DataFrame, tokenizers: str, model: PieceModel | None, rows_of, schema: str) -> DataFrame:
    """The rows that a function of (id, label, text, stretches) makes of each document."""
    held = docs.sparkSession.sparkContext.broadcast(model or train_languages(samples, docs, tokenizers))
    names = [c.split(" ")[0] for c in schema.split(", ")]
    types = [{"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}[c.split(" ")[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [c.to_pylist() for c in batch.columns]
            rows = [r for i, label, text, found in zip(*given, held.value.stretches_of(given[2]), strict=True) for r in rows_of(i, label, text, found)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    given = clashless(docs, ["doc_id", "lang", "text"]).where("doc_id is not null and text <> ''")
    return spread(given).mapInArrow(run, schema)


_CODES = {name: code for code, names in LANGUAGES.items() for name in names}
_BARE = regex.compile(r"\s*(\p{L}+)")


def code_of(label: str | None) -> str | None:
    """The language a label names, whatever its spelling and region; None if it names none of the known ones."""
    m = _BARE.match(label or "")
    return _CODES.get(m[1].lower()) if m else None


def label_code(label: str | Column) -> Column:
    """The same as a column."""
    bare = F.regexp_extract(F.lower(F.trim(label)), r"^(\p{L}+)", 1)
    return F.element_at(F.create_map(*[F.lit(x) for pair in _CODES.items() for x in pair]), bare)


def labels_of(label: str | None, n_chars: int, found: list[tuple[int, int, str, float, int, int]]) -> list[str]:
    """The languages to report of a document: all of a mixed one, or that of a document whose label is missing or wrong."""
    if n_chars < SHORT or not found:
        return []
    words: dict[str, int] = defaultdict(int)
    whole = set()
    for _, _, lang, _, n, longest in found:
        words[lang] += n
        if longest >= WHOLE_SENTENCE:
            whole.add(lang)
    main = max(words, key=lambda c: (words[c], c))
    if len(whole) > 1:
        return sorted(whole)
    return [] if code_of(label) == main else [main]


def wrong_labels(docs: DataFrame, samples: DataFrame, tokenizers: str = TOKENIZERS, model: PieceModel | None = None) -> DataFrame:
    """(doc_id, lang): the language of documents with a missing or wrong label, and every language of mixed ones.

    A language is mixed in if a stretch in it holds a whole sentence; see sentences(). Texts of fewer than SHORT
    characters and such without a word give no row, nor do null ids and texts; repeated rows come out once.
    """
    found = _per_document(docs, samples, tokenizers, model, lambda i, label, text, found: [(i, c) for c in labels_of(label, len(text), found)], "doc_id bigint, lang string")
    return found.distinct()
