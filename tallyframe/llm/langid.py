"""Languages of documents and of the stretches of one language inside them.

Bit-sliced Bloom filters: one table of language bitmasks, three slots per n-gram; the AND of the
slots gives every language that holds the n-gram. A word's evidence for a language is its popcount
over the word's n-grams, corrected for the filter's false positives. A Viterbi pass over the words
finds the stretches.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise, spread

LANGUAGES = ("en", "es", "pt", "fr", "de", "it", "nl", "pl", "tr", "ru", "ja")
# Spellings of each language in labels, besides codes with a region ('pt-BR').
SPELLINGS = {
    "en": "en eng english short_en_rule anglais inglés",
    "es": "es spa esp spanish español espanol castellano",
    "pt": "pt por portuguese português portugues",
    "fr": "fr fra fre french français francais",
    "de": "de deu ger german deutsch",
    "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands",
    "pl": "pl pol polish polski",
    "tr": "tr tur turkish türkçe turkce",
    "ru": "ru rus russian русский",
    "ja": "ja jpn jp japanese 日本語",
}
# Frequent function words, so that a language without labelled rows isn't empty.
SEEDS = {
    "en": "the and of to is was that it for with this have not but are they you my on at from what when about would there been your which she he we after because very still good",
    "es": "el la los las de que y en un una por con para es muy pero no se lo como más cuando porque este esta desde hace mi tengo todo también fue son hay",
    "pt": "o a os as de que e em um uma por com para é muito mas não se como mais quando porque este esta desde meu minha tenho tudo também foi são há você ainda depois",
    "fr": "le la les des de que et en un une par avec pour est très mais ne pas se comme plus quand parce ce cette depuis mon ma j'ai tout aussi c'est sont il elle vous nous quel",
    "de": "der die das und in ein eine von mit für ist sehr aber nicht sich wie mehr wenn weil dieser diese seit mein ich habe alles auch war sind es wir noch nach über zu immer",
    "it": "il lo la gli le di che e in un una per con è molto ma non si come più quando perché questo questa da mio ho tutto anche era sono c'è dopo ancora abbiamo",
    "nl": "de het een en van in met voor is zeer maar niet zich als meer wanneer omdat deze dit sinds mijn ik heb alles ook was zijn er wij nog na over te altijd hij",
    "pl": "i w z na do się nie to że jest jak ale po co tak za od przez dla czy mam mój już tylko jeszcze bardzo był są ten ta te kiedy bo może wszystko",
    "tr": "ve bir bu da de için çok ama ne gibi daha değil var yok ben sen o biz ile sonra kadar her şey olan olarak hâlâ bence göre kimse",
    "ru": "и в не на что я с он как это по но они мы из у за от так же для вы бы до после очень уже только ещё был мой когда потому",
    "ja": "は が の を に で と も か から まで です ます した して いる ある ない この その よ ね",
}
CJK = r"\p{Han}\p{Hiragana}\p{Katakana}ー"
_TOKEN = regex.compile(rf"[{CJK}]|[\p{{L}}\p{{M}}]+(?:['’][\p{{L}}\p{{M}}]+)*")
_LINK = regex.compile(r"(?:https?://|www\.)\S+")
_ADDRESS = regex.compile(r"[\w.+-]+\s*(?:@|\(at\)|\[at\])\s*[\w.-]+(?:\s+dot\s+\w+)*|@[\w.-]+")
_NUMBER = regex.compile(r"[A-Za-z_]*\d[A-Za-z\d_./-]*")
_DIGIT = regex.compile(r"\d")
_HAN, _CJK_CHAR = regex.compile(r"\p{Han}"), regex.compile(rf"[{CJK}]$")
_BREAK = regex.compile(r"[.!?…。！？\n/|—–;:]")
_LONG = regex.compile(r"(\p{L})\1{2,}")


def label_language(col: Column) -> Column:
    """Language code that a label names in any spelling, or null."""
    t = F.lower(F.trim(col))
    table = {w: lang for lang, words in SPELLINGS.items() for w in words.split()}
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(known, t), F.try_element_at(known, F.regexp_extract(t, r"^([a-z]{2,3})[-_]", 1)))


def fold(word: str) -> str:
    """Lower case without accents; letters drawn out ('soooo') are shortened."""
    w = _LONG.sub(r"\1", word.lower().replace("’", "'"))
    if w.isascii():
        return w
    if any("Ѐ" <= c <= "ӿ" for c in w):
        return w.replace("ё", "е")
    return "".join(c for c in unicodedata.normalize("NFD", w.replace("ı", "i").replace("ł", "l")) if not unicodedata.combining(c))


def tokens(text: str) -> list[tuple[str, int, int, bool]]:
    """(word, start, end, whether a sentence may begin here). Addresses, handles, links and everything
    with digits are blanked first, keeping offsets."""
    clean, blank = text, lambda m: " " * len(m.group())
    if "http" in text or "www." in text:
        clean = _LINK.sub(blank, clean)
    if "@" in text or "(at)" in text or "[at]" in text:
        clean = _ADDRESS.sub(blank, clean)
    if _DIGIT.search(clean):
        clean = _NUMBER.sub(blank, clean)
    out, last = [], 0
    for m in _TOKEN.finditer(clean):
        start, end = m.span()
        gap = text[last:start]
        out.append((m.group(), start, end, last == 0 or gap != " " and gap != "" and _BREAK.search(gap) is not None))
        last = end
    return out


def grams(word: str) -> list[str]:
    """n-grams of a word: itself as written and folded, and 3- to 5-grams of the folded word with its
    ends marked. One character of Chinese or Japanese script is its own n-gram, with its script."""
    if _CJK_CHAR.match(word):
        return ["w:" + word, "s:han" if _HAN.match(word) else "s:kana"]
    w = fold(word)
    raw = _LONG.sub(r"\1", word.lower().replace("’", "'"))
    out = ["w:" + raw, "f:" + w, "f:" + w]
    p = f"^{w}$"
    for n in (3, 4, 5):
        out.extend(p[i : i + n] for i in range(len(p) - n + 1))
    script = "s:cyr" if "Ѐ" <= w[:1] <= "ӿ" else "s:lat" if w[:1].isascii() else "s:other"
    return out + [script]


@dataclass
class BitFilter:
    """``slots`` language bitmasks (uint16). ``false_rate`` per language from the share of set bits."""

    slots: int = 1 << 20
    probes: int = 3
    table: np.ndarray = field(default=None)

    def __post_init__(self):
        if self.table is None:
            self.table = np.zeros(self.slots, dtype=np.uint16)

    def places(self, gram_list: list[str]) -> np.ndarray:
        h = np.fromiter((xxhash.xxh3_64_intdigest(g) for g in gram_list), dtype=np.uint64, count=len(gram_list))
        step = (h >> np.uint64(32)) | np.uint64(1)
        return np.stack([((h + np.uint64(i) * step) % np.uint64(self.slots)).astype(np.int64) for i in range(self.probes)])

    def add(self, masks: dict[str, int]) -> None:
        if masks:
            at = self.places(list(masks))
            m = np.fromiter(masks.values(), dtype=np.uint16, count=len(masks))
            for row in at:
                np.bitwise_or.at(self.table, row, m)

    def languages(self, gram_list: list[str]) -> np.ndarray:
        """Bitmask of the languages that may hold each n-gram."""
        at = self.places(gram_list)
        return np.bitwise_and.reduce(self.table[at], axis=0)

    def false_rate(self) -> np.ndarray:
        used = np.array([(self.table >> np.uint16(i) & np.uint16(1)).mean() for i in range(len(LANGUAGES))])
        return used**self.probes


class LanguageModel:
    """Filter, evidence per word, and the search for stretches."""

    def __init__(self, bits: BitFilter, weight: float = 1.6, switch: float = 5.0, switch_at_break: float = 2.8, title: float = 0.3, memo: int = 200_000):
        self.bits, self.weight = bits, weight
        self.switch, self.switch_at_break = switch, switch_at_break
        self.title = title
        self.false = bits.false_rate()
        self.memo: dict[str, int] = {}
        self.scores = np.zeros((1024, len(LANGUAGES)))
        self.limit = memo

    def evidence(self, words: set[str]) -> None:
        """Fill the memo for new words, all n-grams in one filter query."""
        new = [w for w in words if w not in self.memo]
        if len(self.memo) + len(new) > self.limit:
            self.memo.clear()
            new = list(words)
        if not new:
            return
        lists = [grams(w) for w in new]
        flat = [g for x in lists for g in x]
        masks = self.bits.languages(flat)
        hits = (masks[:, None] >> np.arange(len(LANGUAGES), dtype=np.uint16)) & 1
        starts = np.cumsum([0] + [len(x) for x in lists[:-1]])
        counts = np.add.reduceat(hits.astype(np.float64), starts, axis=0)
        n = np.array([len(x) for x in lists], dtype=np.float64)[:, None]
        share = np.clip((counts / n - self.false) / (1 - self.false), 0, 1)
        best = share.max(axis=1, keepdims=True)
        score = np.where(best > 0.25, self.weight * (share - best), 0.0)
        first = len(self.memo)
        if first + len(new) > len(self.scores):
            grown = np.zeros((max(2 * len(self.scores), first + len(new)), len(LANGUAGES)))
            grown[:first] = self.scores[:first]
            self.scores = grown
        self.scores[first : first + len(new)] = score
        for i, w in enumerate(new, first):
            self.memo[w] = i

    def rows(self, words: list[str]) -> np.ndarray:
        """Evidence of each word, one row each."""
        self.evidence(set(words))
        return self.scores[[self.memo[w] for w in words]]

    def segments(self, text: str) -> list[tuple[str, float, int, int]]:
        """(language, confidence, start, end) of the maximal stretches in one language, in order."""
        toks = tokens(text)
        if not toks:
            return []
        e = self.rows([t[0] for t in toks])
        names = np.array([t[0].istitle() and len(t[0]) > 1 and not t[3] for t in toks])
        e[names] *= self.title  # words like names inside a sentence say little
        telling = e.min(axis=1) < -0.2
        if not telling.any():
            return []
        total = e.sum(axis=0)
        best = int(total.argmax())
        n = len(toks)
        if total[best] > -self.switch_at_break:
            path = np.full(n, best)
        else:
            back = np.zeros((n, len(LANGUAGES)), dtype=np.int8)
            score = e[0].copy()
            for i in range(1, n):
                cost = self.switch_at_break if toks[i][3] else self.switch
                top = int(score.argmax())
                moved = score[top] - cost
                stay = score >= moved
                back[i] = np.where(stay, np.arange(len(LANGUAGES)), top)
                score = np.where(stay, score, moved) + e[i]
            path = np.empty(n, dtype=np.int64)
            path[-1] = int(score.argmax())
            for i in range(n - 1, 0, -1):
                path[i - 1] = back[i][path[i]]
        out = []
        i = 0
        while i < n:
            j = i
            while j + 1 < n and path[j + 1] == path[i]:
                j += 1
            own = e[i : j + 1].sum(axis=0)
            rival = np.delete(own, path[i]).max()
            conf = 1 / (1 + math.exp(-max(-30.0, min(30.0, own[path[i]] - rival))))
            if telling[i : j + 1].any():
                lang = LANGUAGES[path[i]]
                if out and out[-1][0] == lang:
                    out[-1] = (lang, max(out[-1][1], conf), out[-1][2], toks[j][2])
                else:
                    out.append((lang, conf, toks[i][1], toks[j][2]))
            i = j + 1
        return out

    def language(self, words: list[str]) -> str | None:
        """The language with most evidence over the words of a text."""
        if not words:
            return None
        e = self.rows(words)
        return LANGUAGES[int(e.sum(axis=0).argmax())] if e.min() < -0.2 else None


def _masks(rows: list[tuple[list[str], str]], keep: float, least: int) -> dict[str, int]:
    """n-gram -> bitmask: the languages whose rate of the n-gram is at least ``keep`` of the highest."""
    words = [Counter() for _ in LANGUAGES]
    for ws, lang in rows:
        words[LANGUAGES.index(lang)].update(ws)
    totals = [c.total() for c in words]
    counts = [Counter() for _ in LANGUAGES]
    cache: dict[str, list[str]] = {}
    for c, out in zip(words, counts):
        for w, n in c.items():
            g = cache.get(w)
            if g is None:
                g = cache[w] = list(set(grams(w)))
            for x in g:
                out[x] += n
    seen: dict[str, list[float]] = {}
    for i, c in enumerate(counts):
        for g, n in c.items():
            if n >= least:
                seen.setdefault(g, [0.0] * len(LANGUAGES))[i] = n / max(totals[i], 500)
    out = {}
    for g, rates in seen.items():
        top = max(rates)
        out[g] = sum(1 << i for i, r in enumerate(rates) if r >= keep * top)
    return out


def fit(rows: list[tuple[str, str]], keep: float = 0.2, rounds: int = 2) -> LanguageModel:
    """Filter from labelled texts, some of them labelled wrong.

    An n-gram goes to the languages in which it is about as frequent as where it is most frequent, so
    strays from wrong labels stay out; after each round rows that the model reads otherwise are left
    out. The seed words are added for every language.
    """
    seeds: dict[str, int] = {}
    for i, lang in enumerate(LANGUAGES):
        for w in SEEDS[lang].split() if lang != "ja" else SEEDS[lang].replace(" ", ""):
            for g in ("w:" + w, "f:" + fold(w)) if lang != "ja" else ("w:" + w,):
                seeds[g] = seeds.get(g, 0) | 1 << i
    seeds |= {"s:cyr": 1 << LANGUAGES.index("ru"), "s:kana": 1 << LANGUAGES.index("ja"), "s:han": 1 << LANGUAGES.index("ja")}
    seeds["s:lat"] = sum(1 << i for i, x in enumerate(LANGUAGES) if x not in ("ru", "ja"))
    split = [([t[0] for t in tokens(text)], lang) for text, lang in rows]
    model, kept = None, split
    for _ in range(rounds):
        masks = _masks(kept, keep, 2)
        for s in ("s:cyr", "s:kana", "s:han", "s:lat"):
            masks.pop(s, None)
        bits = BitFilter()
        bits.add(masks)
        bits.add({g: m for g, m in seeds.items() if g not in masks})
        model = LanguageModel(bits)
        kept = [(ws, lang) for ws, lang in split if model.language(ws) == lang]
    return model


def training_rows(texts: DataFrame, named: DataFrame, per_language: int = 3000, most_copies: int = 8) -> list[tuple[str, str]]:
    """About ``per_language`` labelled texts of each language: the documented bound of what the driver
    fits on. Keys are drawn from the labels by a hash threshold that follows each language's count, so
    nothing is sorted; the drawn keys (at most about ``per_language`` x languages) are broadcast to
    the texts. ``texts``: k, t; ``named``: k, code. Twice as many keys as wanted, or ``most_copies`` texts
    a key on average, are an error and no rows are left out."""
    sizes = {r.code: r.n for r in named.groupBy("code").agg(F.count("*").alias("n")).collect()}  # one row per language
    sizes = {x: n for x, n in sizes.items() if x in LANGUAGES}
    if not sizes:
        return []
    share = F.try_element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))]), F.col("code"))
    unit = F.pmod(F.xxhash64(F.lit("lang"), F.col("k").cast("string")), F.lit(1 << 40).cast("bigint")) / float(1 << 40)
    bound = 2 * per_language * len(LANGUAGES)
    drawn = materialise(named.filter(unit < share), "labels")
    if drawn.count() > bound:
        raise ValueError(f"more than {bound} training keys drawn")
    rows = texts.filter("t IS NOT NULL").join(F.broadcast(drawn), "k").select("k", "t", "code").limit(most_copies * bound + 1).collect()
    if len(rows) > most_copies * bound:
        raise ValueError(f"more than {most_copies * bound} training texts: keys have too many")
    return sorted((r.t, r.code) for r in rows)


def segment_languages(df: DataFrame, key: str, text: str, model: LanguageModel) -> DataFrame:
    """key, segment_no (from 1), segments, lang_code, confidence, start, end: the stretches of each text.

    Texts without words of a known language (null, empty, emoji, numbers, names alone) give no row.
    Offsets are characters of the text. Each batch works per distinct text; the model is broadcast and
    of fixed size (2 MB).
    """
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model.bits.table)
    base = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t IS NOT NULL AND t <> ''"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = LanguageModel(BitFilter(table=shared.value))
        for pdf in batches:
            codes, values = pd.factorize(pdf["t"])
            found = [own.segments(v) for v in values]
            rows = [(k, no, len(found[c]), *seg) for k, c in zip(pdf["k"], codes) for no, seg in enumerate(found[c], 1)]
            yield pd.DataFrame(rows, columns=["k", "segment_no", "segments", "lang_code", "confidence", "start", "end"])

    out = base.mapInPandas(run, f"k {kind}, segment_no bigint, segments bigint, lang_code string, confidence double, start bigint, `end` bigint")
    return out.withColumnRenamed("k", key)


def document_languages(comments: DataFrame, labels: DataFrame, key: str = "comment_id", text: str = "text", label_key: str = "id", label: str = "language", per_language: int = 3000) -> DataFrame:
    """comment_id, segment_no, lang_code, confidence, segments, label_code of every text with words.

    ``label_code`` is the language its label names, or null. Repeats of a key with one text count
    once (a key with several texts gives the stretches of each); null keys are left out. The filter is
    fitted on about ``per_language`` labelled rows of each language; every row is then read whole.
    Texts are never shuffled, only their stretches, on the key.
    """
    texts = comments.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("k IS NOT NULL")
    named = labels.select(F.col(label_key).alias("k"), label_language(F.col(label)).alias("code")).filter("k IS NOT NULL AND code IS NOT NULL").groupBy("k").agg(F.max("code").alias("code"))
    model = fit(training_rows(texts, named, per_language))
    segs = segment_languages(texts, "k", "t", model).join(named, "k", "left")
    out = segs.select(F.col("k").alias(key), "segment_no", "lang_code", "confidence", "segments", F.col("code").alias("label_code"))
    return out.dropDuplicates()


def wrong_labels(languages: DataFrame) -> DataFrame:
    """The rows of :func:`document_languages` whose label is missing or names another language, or
    whose text has several."""
    return languages.filter(F.col("label_code").isNull() | (F.col("segments") > 1) | (F.col("label_code") != F.col("lang_code")))
