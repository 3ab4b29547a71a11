"""Missing or wrong document languages, and languages of mixed texts, by word-first backoff.

A sentence is scored word by word: a known word by its log frequency in each language, any other word by its
character n-grams, the longest known ones first. Words are counted once per document, and only those of several
documents are known words, so that names don't become evidence. The frequencies come from labelled documents whose
labels are partly wrong; sentences are therefore labelled again by the first model, and counted again.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from troupe.runtime import materialize, spread

#: Documents to fit on, chosen by a hash of their id; rounds of labelling again; documents that a known word needs.
SAMPLE, ROUNDS, KNOWN, NGRAM, SMOOTH = 10_000, 2, 4, 4, 0.05
#: Unknown words that a worker remembers.
MET = 200_000
#: Most log-frequency difference that one known word, and one unknown word, can make.
WORD_LIMIT, PIECE_LIMIT = 6.0, 1.5
#: A sentence has at least so many words, or characters where words aren't spaced; a language at least this confidence.
WORDS, CHARACTERS, SURE = 3, 6, 0.9

# fixed values: the three-letter codes of ISO 639-2 (both forms) for two-letter ones
THREE_LETTERS = {
    "eng": "en", "spa": "es", "por": "pt", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "jpn": "ja", "zho": "zh", "chi": "zh", "kor": "ko",
    "ita": "it", "nld": "nl", "dut": "nl", "pol": "pl", "rus": "ru",
}

_MARKUP = regex.compile(r"<[^<>]{1,200}>|\]\([^()\s]*\)|https?://\S+|~!|!~|__|\*\*|[\[*`~]")
_ENTITY = regex.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|\w+);")
_HIDDEN = regex.compile(r"[\p{Cf}\p{Cc}--[\n\t]]", regex.V1)
_SENTENCE = regex.compile(r"[^\n.!?。！？]*(?:[.!?](?![\s\"'»”’)\]」』~_*—-]|$)[^\n.!?。！？]*)*(?:[.!?]+(?=[\s\"'»”’)\]」』~_*—-]|$)|[。！？]+)", regex.M)
_TOKEN = regex.compile(r"[\p{Han}々〆]+|\p{Hiragana}+|[\p{Katakana}ー]+|\p{Hangul}+|[\p{L}\p{M}--[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]]+", regex.V1)
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_LETTERS, _OTHER = re.compile(r"[^\W\d_]+"), re.compile("[\u0250-\u1fff\u2100-\U0010ffff]")
_HAN = regex.compile(r"[\p{Han}々〆]+")


def masked(text: str) -> str:
    """text with markup blanked and entities and hidden characters replaced, every character at its place."""
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0])[:1].ljust(len(m[0])) if html.unescape(m[0]) != m[0] else m[0], text)
    return _MARKUP.sub(lambda m: " " * len(m[0]), text)


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of every whole sentence: one that ends with its mark and has enough words. Header lines, lists of
    names and the like have no such mark; a line end ends what is before it."""
    found = []
    for m in _SENTENCE.finditer(masked(text)):
        part = m[0] if m[0].isprintable() else _HIDDEN.sub("", m[0])
        part = (part if part.isascii() else unicodedata.normalize("NFKC", part)).lower()
        # without marks and scripts of their own kinds of words, a word is a run of letters
        words = _TOKEN.findall(part) if _OTHER.search(part) else _LETTERS.findall(part)
        if len(words) >= WORDS or len(_UNSPACED.findall(part)) >= CHARACTERS:
            found.append((m.start(), m.end(), words))
    return found


class Model:
    """Log frequencies of known words and of n-grams in each of `langs`."""

    def __init__(self, langs: list[str], words: dict[str, np.ndarray], pieces: dict[str, np.ndarray]):
        self.langs, self.words, self.pieces = langs, words, pieces
        self._keep_known()

    def _keep_known(self) -> None:
        """The evidence of each word by its row in one matrix: that of known words, to which unknown ones are added as they are met."""
        self._place = {w: k for k, w in enumerate(self.words)}
        self._rows = np.zeros((len(self.words) + 1024, len(self.langs)), np.float32)
        if self.words:
            self._rows[: len(self.words)] = np.stack(list(self.words.values()))

    def _add(self, word: str) -> int:
        k = self._place[word] = len(self._place)
        if k >= len(self._rows):
            self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)])
        self._rows[k] = self.unknown(word)
        return k

    @classmethod
    def of_counts(cls, langs: list[str], words: tuple[list[str], np.ndarray], pieces: tuple[list[str], np.ndarray], by_length: np.ndarray) -> Model:
        """From documents by known word and language, weights by n-gram and language, and the latter summed by length of n-gram."""
        known, c = words
        totals = np.maximum(c.sum(axis=0), 1)
        scores = _limited(np.log((c + SMOOTH) / (totals + SMOOTH * max(len(known), 1))), WORD_LIMIT)
        grams, g = pieces
        size = np.fromiter(map(len, grams), np.int64, len(grams))
        each = np.log((g + 0.5) / by_length[size]) if len(grams) else np.zeros((0, len(langs)))
        each = (each - each.max(axis=1, keepdims=True, initial=-np.inf)).astype(np.float32)
        return cls(langs, dict(zip(known, scores)), dict(zip(grams, each)))

    def unknown(self, word: str) -> np.ndarray:
        """Evidence of a word that isn't known: the mean of its known n-grams of the greatest length that has any."""
        padded = f" {word} "
        for size in range(NGRAM, 0, -1):
            hits = [s for at in range(len(padded) - size + 1) if (s := self.pieces.get(padded[at : at + size])) is not None]
            if hits:
                # a run of Han is rarely one word; it may say as much as the words that it could be
                times = max(1.0, len(word) / 2) if _HAN.fullmatch(word) else 1.0
                return _limited(np.mean(hits, axis=0) * times, PIECE_LIMIT * times)
        return np.zeros(len(self.langs), np.float32)

    def evidence(self, lists: list[list[str]]) -> np.ndarray:
        """Summed evidence of each list of words."""
        out = np.zeros((len(lists), len(self.langs)), np.float32)
        if len(self._place) > len(self.words) + MET:
            self._keep_known()
        place, add = self._place, self._add
        rows = np.array([k if (k := place.get(w)) is not None else add(w) for words in lists for w in words], np.int64)
        if len(rows):
            sizes = np.array([len(x) for x in lists])
            filled = np.flatnonzero(sizes)
            out[filled] = np.add.reduceat(self._rows[rows], np.cumsum(sizes[filled]) - sizes[filled], axis=0)
        return out

    def confidence(self, evidence: np.ndarray) -> np.ndarray:
        """Posterior of each language under equal priors."""
        e = np.exp(evidence - evidence.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def __getstate__(self):
        return {"langs": self.langs, "words": self.words, "pieces": self.pieces}

    def __setstate__(self, state):
        self.__init__(**state)


def _pieces(word: str) -> Iterator[str]:
    padded = f" {word} "
    for size in range(1, NGRAM + 1):
        for at in range(len(padded) - size + 1):
            if (x := padded[at : at + size]) != " ":
                yield x


def _limited(scores: np.ndarray, most: float) -> np.ndarray:
    return np.maximum(scores - scores.max(axis=-1, keepdims=True, initial=-np.inf), -most).astype(np.float32)


def label_code(label: str | Column, codes: list[tuple[str, str]]) -> Column:
    """The code that a label stands for: a code or name of `codes` in any case, a three-letter code, or any of these
    before a region or script (en-US, zh_Hans); null where it names no language."""
    clean = F.lower(F.trim(F.col(label) if isinstance(label, str) else label))
    head = F.regexp_extract(clean, r"^([^-_\s(]*)", 1)
    known = {c: c for c, _ in codes} | {name.lower(): c for c, name in codes} | {k: v for k, v in THREE_LETTERS.items() if v in {c for c, _ in codes}}
    table = F.create_map(*[F.lit(x) for pair in sorted(known.items()) for x in pair])
    return F.coalesce(F.try_element_at(table, clean), F.try_element_at(table, head))


def _by_language(langs: list[str]) -> list[str]:
    return [f"c{k}" for k in range(len(langs))]


def _word_pieces(langs: list[str]):
    """Words with their counts by language to n-grams with theirs, summed within the batch; a frequent word isn't all of a language."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.minimum(np.stack([batch.column(k + 1).to_numpy() for k in range(len(langs))], axis=1), 20)
            place: dict[str, int] = {}
            at, row = [], []
            for k, word in enumerate(batch.column(0).to_pylist()):
                for x in _pieces(word):
                    at.append(place.setdefault(x, len(place)))
                    row.append(k)
            sums = np.zeros((len(place), len(langs)))
            np.add.at(sums, np.array(at, int), counts[np.array(row, int)])
            yield pa.RecordBatch.from_arrays([pa.array(list(place), pa.string()), *map(pa.array, sums.T)], ["piece", *_by_language(langs)])

    return kernel


def _counted(sentences_: DataFrame, langs: list[str]) -> Model:
    """The model of sentences (doc, lang, words): documents by word and language, and n-grams of the words, counted where the sentences are."""
    cols = _by_language(langs)
    once = sentences_.where("lang >= 0").select("doc", "lang", F.explode("words").alias("word")).distinct()
    words = materialize(once.groupBy("word").agg(*[F.count_if(F.col("lang") == k).cast("double").alias(c) for k, c in enumerate(cols)]), "language-words")
    total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    schema = ", ".join(["piece string", *(f"{c} double" for c in cols)])
    pieces = spread(words).mapInArrow(_word_pieces(langs), schema).groupBy("piece").agg(*[F.sum(c).alias(c) for c in cols])
    pieces = materialize(pieces, "language-pieces")
    sums = {r["size"]: [r[c] for c in cols] for r in pieces.groupBy(F.length("piece").alias("size")).agg(*[F.sum(c).alias(c) for c in cols]).collect()}
    by_length = np.ones((NGRAM + 1, len(langs)))
    for size, x in sums.items():
        by_length[size] += x

    def taken(df: DataFrame) -> tuple[list[str], np.ndarray]:
        got = df.toArrow()
        return got.column(0).to_pylist(), np.stack([got.column(c).to_numpy() for c in cols], axis=1) if got.num_rows else np.zeros((0, len(langs)))

    return Model.of_counts(langs, taken(words.where(total >= KNOWN)), taken(pieces.where(total >= 3)), by_length)


def fit_model(df: DataFrame, identifier: str, text: str, label: str, codes: list[tuple[str, str]], sample: int = SAMPLE) -> Model:
    """A model from about `sample` labelled documents, chosen by a hash of their identifier and read whole. Only the fit is on a sample; every
    document is labelled. Sentences and counts stay distributed: what the driver holds is the model, which is broadcast anyway."""
    rows = df.select(F.col(identifier).alias("id"), F.col(text).alias("text"), label_code(label, codes).alias("code")).where("code is not null and text is not null")
    share = min(1.0, sample / max(rows.count(), 1))
    chosen = rows.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.xxhash64("id").alias("doc"), "code", "text")
    split = materialize(spread(chosen).mapInArrow(_sample_sentences, "doc bigint, code string, words array<string>"), "language-sentences")
    langs = [r[0] for r in split.select("code").distinct().orderBy("code").collect()]  # some of `codes`
    if not langs:
        return Model([], {}, {})
    number = F.create_map(*[x for k, c in enumerate(langs) for x in (F.lit(c), F.lit(k))])
    model = _counted(split.select("doc", number[F.col("code")].alias("lang"), "words"), langs)
    for _ in range(ROUNDS):
        again = split.select("doc", "words").mapInArrow(_labelled(df.sparkSession.sparkContext.broadcast(model)), "doc bigint, lang int, words array<string>")
        model = _counted(again, langs)
    return model


def _sample_sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, codes, words = [], [], []
        for doc, code, text in zip(*(c.to_pylist() for c in batch.columns)):
            for _, _, found in sentences(text):
                docs.append(doc)
                codes.append(code)
                words.append(found)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(codes, pa.string()), pa.array(words, pa.list_(pa.string()))], ["doc", "code", "words"])


def _labelled(shared):
    """Sentences (doc, words) with the language that the model is sure of, or -1."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            sure = model.confidence(model.evidence(batch.column(1).to_pylist()))
            lang = np.where(sure.max(axis=1) >= SURE, sure.argmax(axis=1), -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), batch.column(1)], ["doc", "lang", "words"])

    return kernel


_SEGMENT = "id bigint, segment int, start int, end int, sentences int, lang string, confidence double"


def language_segments(df: DataFrame, identifier: str, text: str, model: Model) -> DataFrame:
    """(id, segment, start, end, sentences, lang, confidence): the runs of sentences in one language of every text, in order.
    start and end are character places in the text; confidence is the mean posterior of the sentences, weighted by length.

    Null and empty texts, and those without a whole sentence, have no segments. A sentence whose best language has a
    confidence below SURE joins the segment before it (or, at the beginning, the one after it) and doesn't begin one of its own; if
    no sentence reaches it, all of them together are one segment.
    Rows with a null identifier are left out; repeated rows give repeated segments."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = []
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = sentences(content) if content else []
                if not found or not own.langs:
                    continue
                sure = own.confidence(own.evidence([w for _, _, w in found]))
                best, most = sure.argmax(axis=1).tolist(), sure.max(axis=1).tolist()
                runs: list[list] = []
                for (start, end, _), k, p in zip(found, best, most):
                    lang = own.langs[k]
                    held = p if p >= SURE else 0.0
                    if runs and (not held or runs[-1][3] in (lang, None)):
                        runs[-1][1] = end
                        runs[-1][2] += 1
                        if held and runs[-1][3] is None:
                            runs[-1][3] = lang
                    else:
                        runs.append([start, end, 1, lang if held else None, 0.0, 0])
                    if held:
                        runs[-1][4] += held * (end - start)
                        runs[-1][5] += end - start
                if len(runs) == 1 and runs[0][3] is None:  # no sentence is sure by itself: all of them together decide
                    whole = own.confidence(own.evidence([[w for _, _, words in found for w in words]]))[0]
                    runs[0][3:] = own.langs[int(whole.argmax())], float(whole.max()), 1
                rows += [(key, i, a, b, n, lang, c / size) for i, (a, b, n, lang, c, size) in enumerate(runs) if lang]
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["id", "segment", "start", "end", "sentences", "lang", "confidence"])

    rows = df.select(F.col(identifier).cast("bigint").alias("id"), F.col(text).alias("text")).where("id is not null")
    return spread(rows).mapInArrow(kernel, _SEGMENT)


def document_languages(segments: DataFrame) -> DataFrame:
    """(id, lang, languages, confidence): the language that most of each text is in, by characters of its sentences (ties by code),
    all languages with a sentence, sorted, and the confidence of the main one."""
    size = F.col("end") - F.col("start")
    each = segments.groupBy("id", "lang").agg(F.sum(size).alias("size"), (F.sum(F.col("confidence") * size) / F.sum(size)).alias("confidence"))
    best = F.min_by(F.struct("lang", "confidence"), F.struct(-F.col("size"), "lang"))
    return each.groupBy("id").agg(best.alias("best"), F.array_sort(F.collect_set("lang")).alias("languages")).select("id", "best.lang", "languages", "best.confidence")


def wrong_languages(df: DataFrame, identifier: str, text: str, label: str, codes: list[tuple[str, str]], sample: int = SAMPLE) -> DataFrame:
    """(id, languages, lang, confidence, label): documents whose label is missing, names another language than most of the text, or
    whose text has whole sentences in more than one language. Texts without a sentence are never among them."""
    model = fit_model(df, identifier, text, label, codes, sample)
    found = document_languages(language_segments(df, identifier, text, model))
    labels = df.select(F.col(identifier).cast("bigint").alias("id"), label_code(label, codes).alias("label"))
    wrong = F.col("label").isNull() | (F.col("label") != F.col("lang")) | (F.size("languages") > 1)
    return labels.join(found, "id").where(wrong).select("id", "languages", "lang", "confidence", "label")
