"""URL filters: rules by host and path, and for the rest host word segmentation with multinomial naive Bayes.

A name is cut into words by a unigram Viterbi search. Half of a word's probability is its share of all words of the table's
urls' paths and pages' texts, however many and long: these counts stay a table, and the substrings of every distinct name
are joined to it. The other half comes from the ranks of a public tokenizer's whole words by Zipf's law. Naive Bayes
scores the host's and path's tokens; its examples are lists of words by the kind of page that they are usual on. Rules win
over the model; the longest rule that fits wins over the others.

Defined results: a null url, or one without ://, has an empty host and path, no rule, and verdict allow; null html has no
words; an empty table gives an empty one; ties of rules of one length go to block; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import BROADCAST_BYTES, BROADCAST_ROWS, materialize, tidy

#: (verdict, host, path start)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: Words of pages that a filter blocks, by kind of page. The model takes each kind as one example, plurals included.
BLOCKED = {
    "gambling": "casino poker slot roulette blackjack jackpot baccarat bingo lottery lotto bet betting bookmaker bookie wager gamble gambling odds sportsbook tipster spin",
    "adult": "adult sex porn porno xxx nude naked erotic escort fetish hentai webcam camgirl milf hookup sexy stripper nsfw",
    "pharmacy": "pill pharmacy viagra cialis levitra steroid xanax valium tramadol prescription meds drugstore slimming anabolic",
    "malware": "warez crack cracked keygen serial torrent hack hacked malware phishing exploit botnet trojan stealer carding",
    "money": "payday loan forex bitcoin crypto investment doubler giveaway bonus profit millionaire",
    "fakes": "replica counterfeit fake knockoff rolex outlet",
    "spam": "spam spammer backlink seo traffic doorway autoblog splog",
    "advertising": "ad ads advert adserver banner popup popunder tracker tracking clicktrack affiliate sponsor doubleclick pixel beacon",
}
#: The same of pages that it allows.
ALLOWED = {
    "news": "news daily times post journal herald press report weather story magazine world today politics",
    "learning": "school university college library course lesson learn math science history language dictionary wiki encyclopedia museum research",
    "technology": "code docs developer software open source data cloud linux python forum support download manual tutorial",
    "home": "garden recipe food kitchen cook travel guide hotel city house family baby pet dog cat wedding",
    "health": "health doctor clinic hospital dental care medical wellness yoga fitness",
    "culture": "music film movie book art photo gallery theatre band radio tv review game sport football club team",
    "business": "shop store company bank insurance lawyer office job career market trade auto car design studio",
    "public": "gov council police church charity community foundation society association park transport station",
    "personal": "blog diary my home page about contact friends notes people",
}
#: Words of pages of either kind, which say nothing: part of every example.
NEUTRAL = "www blog m example com net org en de fr es html index page free best cheap online win play hot link track farm live buy sale top new the of and".split()

_LETTERS = re.compile(r"[^\W\d_]+")


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    tail = rest[end:]
    stop = next((i for i, c in enumerate(tail) if c in "?#"), len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


def match_rule(host: str, path: str, rules=RULES) -> tuple[str | None, str | None]:
    """The longest rule that fits the host or a parent domain and the path's start, and its verdict."""
    best: tuple[int, bool, str, str] | None = None
    for verdict, domain, start in rules:
        if host and (host == domain or host.endswith("." + domain)) and path.startswith(start):
            here = (len(domain) + len(start), verdict == "block", domain + start, verdict)
            best = here if best is None or here > best else best
    return (best[2], best[3]) if best else (None, None)


class Segmenter:
    """Unigram Viterbi: the cut of a name into words with the greatest product of word probabilities.

    An unknown word of n letters has the probability of one occurrence, divided by ten for every letter. total: of all
    counts and one, where counts holds only the words that occur in the names to be cut."""

    def __init__(self, counts: dict[str, float], total: float | None = None):
        total = total or sum(counts.values()) + 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.unknown = math.log(total)
        self.lengths = sorted({len(w) for w in counts}, reverse=True)

    def cut(self, name: str) -> tuple[str, ...]:
        # a known word never costs more than the same letters as an unknown one, so of the unknown words that end at one
        # letter only that with the least cost before it counts: "run" is where it begins
        letter = math.log(10)
        best, back, run = [0.0], [0], 0
        for end in range(1, len(name) + 1):
            if best[end - 1] - (end - 1) * letter < best[run] - run * letter:
                run = end - 1
            least, at = best[run] + self.unknown + (end - run) * letter, run
            for n in self.lengths:
                if n <= end and (cost := self.cost.get(name[end - n : end])) is not None:
                    cost += best[end - n]
                    if cost < least or (cost == least and end - n < at):
                        least, at = cost, end - n
            best.append(least)
            back.append(at)
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        return tuple(out[::-1])


class NaiveBayes:
    """Multinomial naive Bayes with add-one smoothing; log odds of bad over good."""

    def __init__(self, good: list[list[str]], bad: list[list[str]]):
        g, b = Counter(t for x in good for t in x), Counter(t for x in bad for t in x)
        kinds = set(g) | set(b)
        ng, nb = sum(g.values()) + len(kinds), sum(b.values()) + len(kinds)
        self.prior = 0.0  # classes are taken as equally likely
        self.odds = {t: math.log((b[t] + 1) / nb) - math.log((g[t] + 1) / ng) for t in kinds}

    def score(self, tokens: list[str]) -> float:
        return self.prior + sum(self.odds.get(t, 0.0) for t in tokens)


def raw_tokens(url: str) -> list[str]:
    return _LETTERS.findall(url.lower())


def build_model(blocked: dict[str, str] = BLOCKED, allowed: dict[str, str] = ALLOWED) -> NaiveBayes:
    both = lambda words: [x for w in words.split() for x in (w, w + "s")]
    return NaiveBayes([both(w) + NEUTRAL for w in allowed.values()], [both(w) + NEUTRAL for w in blocked.values()])


def lexicon(path: str) -> dict[str, float]:
    """Shares of the whole words of a public vocabulary of word pieces, by Zipf's law over their ranks; the model's words
    that it lacks come last."""
    with open(path, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    words = [w[:-4] for w, _ in sorted(ids.items(), key=lambda x: x[1]) if w.endswith("</w>") and w.isascii() and w[:-4].isalpha() and len(w) > 6]
    words += [w for kinds in (BLOCKED, ALLOWED) for x in kinds.values() for w in x.split()]
    ranks = {w: k + 1 for k, w in reversed(list(enumerate(words)))}
    all_ = sum(1 / k for k in ranks.values())
    return {w: 1 / k / all_ for w, k in ranks.items()}


_FACTOR = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_HASHES = 1 << 16  # of substrings that are handed on at a time


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]), dtype=np.uint64)


def substring_hashes(name: str, lengths: list[int]):
    """Arrays of the 64-bit hashes of all substrings with these lengths, one array a length. Equal substrings have equal
    hashes; a word that only shares a hash is not in the name, so no cut can use it."""
    letters = np.frombuffer(name.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(letters * _powers(_FACTOR, len(name))[:-1], dtype=np.uint64)])
    back = _powers(_INVERSE, len(name))
    for n in lengths:
        if n <= len(name):
            yield ((sums[n:] - sums[:-n]) * back[: len(name) - n + 1]).view(np.int64)


def word_hashes(words: list[str]) -> np.ndarray:
    """substring_hashes of whole words, none of them empty."""
    size = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(size) - size
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    place = np.arange(len(letters)) - np.repeat(first, size)
    terms = letters * _powers(_FACTOR, int(size.max(initial=0)))[place]
    return np.add.reduceat(terms, first).view(np.int64) if len(words) else np.zeros(0, np.int64)


def table_words(pages: DataFrame) -> DataFrame:
    """word, n, h: counts of the words of all urls' paths and pages' texts (html without scripts, styles, comments, tags and
    references), and the words' hashes. Host names are left out: there, words stand together, and such a name counted as a
    word would never be cut."""
    path = F.regexp_extract("url", "(?s)^.*?://[^/?#]*([^?#]*)", 1)
    text = F.regexp_replace("html", "(?s)<(?:!--.*?-->|((?i:script|style))\\b.*?</\\1\\s*>|[^>]*>)|&#?\\w+;", " ")
    words = F.explode(F.filter(F.split(F.lower(F.concat_ws(" ", path, text)), "[^\\p{L}]+"), lambda w: F.length(w) > 0))
    counts = pages.select(words.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))

    @tidy
    def hashed(batches):
        for batch in batches:
            h = word_hashes(batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(h)], names=["word", "n", "h"])

    return counts.mapInArrow(hashed, "word string, n long, h long")


def cut_names(names: DataFrame, words: DataFrame, known_words: dict[str, float]) -> DataFrame:
    """name, words: every one of the distinct names, cut. words: of table_words; a name meets those that are among its
    substrings, so no task holds them all. known_words: shares of lexicon(), which weigh as much as the table's counts."""
    found = words.agg(F.sum("n"), F.count(F.lit(1)), F.sum(F.octet_length("word") + 32)).first()
    seen, rows, size = (x or 0 for x in found)
    lengths = sorted(r[0] for r in words.select(F.length("word")).distinct().collect())
    weight = float(max(seen, 1_000_000))
    total = seen + weight + 1
    longest = max(map(len, known_words), default=0)
    names = materialize(names.withColumn("name_id", F.monotonically_increasing_id()), "names")

    @tidy
    def substrings(batches):
        def flush(held):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=["name_id", "h"])

        for batch in batches:
            held, n = [], 0
            for name, name_id in zip(batch.column("name").to_pylist(), batch.column("name_id").to_pylist(), strict=True):
                for h in substring_hashes(name, lengths):
                    h = np.unique(h)
                    held.append((np.full(len(h), name_id, np.int64), h))
                    n += len(h)
                    if n >= _HASHES:
                        yield flush(held)
                        held, n = [], 0
            if held:
                yield flush(held)

    slim = F.broadcast(words) if size <= BROADCAST_BYTES and rows <= BROADCAST_ROWS else words
    known = names.mapInArrow(substrings, "name_id long, h long").join(slim, "h")
    known = known.groupBy("name_id").agg(F.collect_list("word").alias("known"), F.collect_list("n").alias("n"))

    @tidy
    def cut(batches):
        for batch in batches:
            out = []
            for name, known, n in zip(*(batch.column(c).to_pylist() for c in ("name", "known", "n")), strict=True):
                counts: dict[str, float] = {}
                for at in range(len(name)):
                    for to in range(at + 1, min(at + longest, len(name)) + 1):
                        if (share := known_words.get(name[at:to])) is not None:
                            counts[name[at:to]] = share * weight
                for w, k in zip(known or (), n or (), strict=True):
                    counts[w] = k + counts.get(w, 0.0)
                out.append(Segmenter(counts, total).cut(name))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(out, pa.list_(pa.string()))], names=["name", "words"])

    return names.join(known, "name_id", "left").select("name", "known", "n").mapInArrow(cut, "name string, words array<string>")


def judge_urls(pages: DataFrame, vocabulary: str, rules=RULES, threshold: float = 0.0) -> DataFrame:
    """page_id, host, path, rule, verdict, score (log odds; null where a rule decides or no host is found), words.

    vocabulary: file of a public vocabulary of word pieces, see lexicon()."""

    @tidy
    def split(batches):
        for batch in batches:
            out = []
            for row, page_id, url in zip(*(batch.column(c).to_pylist() for c in ("row", "page_id", "url")), strict=True):
                host, path = split_url(url)
                out.append((row, page_id, host, path, *match_rule(host, path, rules), raw_tokens(host) + raw_tokens(path)))
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4, pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)],
                names=["row", "page_id", "host", "path", "rule", "verdict", "names"],
            )

    numbered = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url")
    urls = materialize(numbered.mapInArrow(split, "row long, page_id long, host string, path string, rule string, verdict string, names array<string>"), "urls")
    tokens = urls.where("rule is null").select("row", F.posexplode("names").alias("spot", "name"))
    cuts = materialize(cut_names(tokens.select("name").distinct(), materialize(table_words(pages), "words"), lexicon(vocabulary)), "cuts")
    model = build_model()
    rows, size = cuts.agg(F.count(F.lit(1)), F.sum(2 * F.octet_length("name") + 64)).first()
    slim = F.broadcast(cuts) if (size or 0) <= BROADCAST_BYTES and rows <= BROADCAST_ROWS else cuts
    words = tokens.join(slim, "name").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("spot", "words"))).alias("cut"))
    words = words.select("row", F.flatten("cut.words").alias("words"))

    @tidy
    def judge(batches):
        for batch in batches:
            rules, verdicts, words = (batch.column(c).to_pylist() for c in ("rule", "verdict", "words"))
            scores = [model.score(w or []) if rule is None and host else None for rule, host, w in zip(rules, batch.column("host").to_pylist(), words, strict=True)]
            verdicts = [v or ("block" if s is not None and s > threshold else "allow") for v, s in zip(verdicts, scores, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64()), pa.array([w or [] for w in words], pa.list_(pa.string()))],
                names=["page_id", "host", "path", "rule", "verdict", "score", "words"],
            )

    joined = urls.drop("names").join(words, "row", "left").drop("row")
    return joined.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string, score double, words array<string>")
