"""Keyword-stuffed, link-list and tag-pile pages.

Each text is read once, whole, in two ways. For weak labels its lines and sentences are
sorted into links, tags, code, logs, tables and the rest, and the words of the rest into
stretches that repeat the same content words or hold no function words: pages of which most
was read as spam, or little, are labelled. For the trees it is measured by other statistics
of content, layout and links, over the page and as quartiles over its parts. Bagged decision
trees learn the labels from these statistics alone, and a page's prediction is smoothed by
the spam rate of its host. Copies of one text share the highest of their scores.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.replies import _WEIGHTS
from tamarack.operators.parallel import spread
from tamarack.operators.skew import hot_aware_join
from tamarack.storage import materialize

#: Function words of any language known to the library, but for two that shops use as keywords.
FUNCTION_WORDS = frozenset(_WEIGHTS) - {"new", "online"}
#: What the weak labels come from: shares of a page's text that were read as spam. The trees never see these.
LABELLING = ("spam", "repeated", "bare", "links", "tags")
#: What the trees see: statistics of content, layout and links, with quartiles over the parts of a page.
VOTING = (
    "code", "logs", "tables", "functional", "distinct", "digits", "disguised", "per_line", "size", "ended", "sentence", "focus", "urls", "url_text", "url_lines", "url_hosts", "marks", "separators",
    "functional_low", "functional_mid", "functional_high", "focus_low", "focus_mid", "focus_high", "fresh_low", "fresh_mid", "fresh_high",
)
FEATURES = LABELLING + VOTING

_INVISIBLE = re.compile("[​-‏⁠﻿­]+")
_SPELLED = re.compile(r"(?<!\w)(?:[^\W\d_][-._*]){2,}[^\W\d_](?!\w)")
#: Three letters set apart have one between two marks; looked for first, as it is found fast.
_MAY_SPELL = re.compile(r"[-._*][^\W\d_][-._*]")
_LEET = str.maketrans("013457", "oieast")
_LOOKALIKE = str.maketrans("асеорхуіјѕԁɡ", "aceopxyijsdg")
_URL = re.compile(r"(?:https?://|www\.)[^\s\"'<>)\]]+|\b[\w-]+(?:\.[\w-]+)*\.(?:example|test|invalid|com|org|net|info|biz|shop|io|ru|de|fr|es|co)\b[^\s\"'<>)\]]*", re.I)
_DOMAIN = re.compile(r"\bwww\.|\.(?:example|test|invalid|com|org|net|info|biz|shop|io|ru|de|fr|es|co)\b", re.I)
_ANCHOR = re.compile(r'<a\s[^>]*?href="?([^">\s]*)"?[^>]*>|</?[a-zA-Z][^>]*>')
_CODE_WORDS = frozenset("select from where and or group order limit join left with create insert having on case union inner outer offset when then else end values set update delete def return import class".split())
_CODE = re.compile(
    r"(?i)\s*(?:(?:where|and|or|on|having|when|case)\b.*(?:[=<>]|\bbetween\b|\bexists\b|\bis (?:not )?null\b|\bin \()|(?:select|create table|insert into|delete from|update \w+ set|union|(?:group|order) by|limit \d|offset \d|with \w+ as\b)\b.*|(?:from|(?:left |inner |outer |full |cross )*join)\s+[\w.\"`]+(?:\s+[\w\"`]+){0,2}(?:\s+on\b.*)?;?$|(?:left|inner|outer|full|cross|select|distinct)$|\);?$|--"
    r"|[\w.\"`]+ (?:integer|text|boolean|timestamptz?|numeric|varchar|date|bigint|serial|smallint|real|double|uuid|json)\b(?:\s*\([\d, ]+\))?(?:\s+(?:not|null|default|primary|unique|check|references|generated|--).*)?[,;)]*\s*$|[\w\"`]+\.?[\w\"`]*_[\w\"`.]*(?: as \w+)?(?: asc| desc)?[,;]?$)"
)
_LOG = re.compile(r"\W{0,3}\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\W{0,2}(?:DEBUG|INFO|WARN|WARNING|ERROR|TRACE|FATAL)\b")
_CELLS = re.compile(r"[|;,\t]")
_NUMBER = re.compile(r"\s*[\w-]*\d[\d.,-]*\s*\Z")
_TAG = re.compile(r"#\w+|\b[^\W\d_]+[:=][^\s,;|]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
_TOKEN = re.compile(r"[^\W_]+|[.!?。！？]+(?=\s|\Z|[^\W\d_])|\n")
_WORD = re.compile(r"[^\W_]+")
_WIDE = re.compile("[぀-ヿ一-鿿가-힯]")
_OTHER = re.compile("[Ͱ-᷿⺀-﷿]")
_REACH, _HALF, _SHORT, _LEAST = 16, 10, 6, 8
_PARTS = 8
_PASS_CHARS = 2_000_000


def _weight(s: str) -> float:
    return len(s) if s.isascii() else len(s) + 1.5 * len(_WIDE.findall(s))


def _functional(words: list[str]) -> int:
    return sum(w in FUNCTION_WORDS or (not w.isascii() and bool(_OTHER.search(w))) for w in words)


def _plain(text: str) -> str:
    if not text.isascii():
        text = _INVISIBLE.sub(lambda m: "" if len(m.group()) == 1 else " ", unicodedata.normalize("NFKC", text))
    return _SPELLED.sub(lambda m: re.sub(r"[-._*]", "", m.group()), text) if _MAY_SPELL.search(text) else text


def _sorted_lines(text: str) -> tuple[list[str], dict[str, float], int, tuple[int, float, int, int]]:
    """(lines of ordinary words, weight of the other kinds of line or sentence, number of lines, links: their number, weight, lines and hosts)."""
    kinds = dict.fromkeys(("links", "tags", "code", "logs", "tables"), 0.0)
    rest: list[str] = []
    linked, link_lines, link_weight, hosts = 0, 0, 0.0, set()
    fenced, n = False, 0
    for line in text.split("\n"):
        s = line.strip()
        if not s:
            continue
        n += 1
        if s.startswith("```"):
            fenced = not fenced
            kinds["code"] += len(s)
            continue
        head = s.split(None, 1)[0].lower().rstrip("(,;:")
        if fenced or ((head in _CODE_WORDS or s[0] in ")-\"`" or "_" in head or head.isalpha()) and _CODE.match(s)):
            kinds["code"] += _weight(s)
            continue
        if (s[0].isdigit() or s[0] in "[(<" or s[:4].isupper()) and _LOG.match(s):
            kinds["logs"] += _weight(s)
            continue
        if "<" in s:
            s = _ANCHOR.sub(lambda m: (m.group(1) + " ") if m.group(1) else " ", s).strip()
        if sum(map(s.count, "|;,\t")) >= 3:
            cells = _CELLS.split(s)
            if sum(bool(_NUMBER.match(c)) for c in cells) >= 0.3 * len(cells):
                kinds["tables"] += _weight(s)
                continue
        if "#" in s or s.count(":") >= 3 or s.count("=") >= 3:
            tags = _TAG.findall(s)
            if len(tags) >= 3 and "://" not in s and sum(map(len, tags)) > 0.6 * len(s):
                kinds["tags"] += _weight(s)
                continue
        if "://" in s or _DOMAIN.search(s):
            link_lines += 1
            for sentence in _SENTENCE.split(s):
                urls = _URL.findall(sentence)
                if urls:
                    linked += len(urls)
                    link_weight += sum(map(len, urls))
                    hosts.update(u.split("//")[-1].split("/")[0].lower() for u in urls)
                    left = _URL.sub(" ", sentence)
                    words = _WORD.findall(left.lower())
                    functional = _functional(words)
                    if functional <= 0.15 * len(words) or len(words) <= 3 * len(urls) and functional <= 0.3 * len(words):
                        kinds["links"] += _weight(sentence)
                        continue
                    sentence = left
                rest.append(sentence)
            continue
        rest.append(s)
    return rest, kinds, n, (linked, link_weight, link_lines, len(hosts))


def _times(order: np.ndarray, again: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How often each word is there in its place; ``order`` sorts by word, ``again`` marks where the word stays the same, places ascend with position."""
    p = place[order]
    run = np.concatenate([[0], np.cumsum(~again | (p[1:] != p[:-1]))])
    out = np.empty(len(order), np.int64)
    out[order] = np.bincount(run)[run]
    return out


def features(texts: list[str | None]) -> np.ndarray:
    """The features of each text, rows in the order of ``texts``; zeros for null and blank ones."""
    out = np.zeros((len(texts), len(FEATURES)))
    index: dict[str, int] = defaultdict(itertools.count().__next__)  # the next number for a new word
    codes: list[int] = []
    ends, kinds_of, lines_of, links_of, marks_of = [], [], [], [], []
    for text in texts:
        rest, kinds, n, links = _sorted_lines(_plain(text)) if text else ([], {}, 0, (0, 0.0, 0, 0))
        links_of.append(links)
        marks_of.append((sum(map(text.count, "#=:")), sum(map(text.count, ",|/;\t"))) if text else (0, 0))
        codes.extend(map(index.__getitem__, _TOKEN.findall("\n".join(rest).lower())))
        ends.append(len(codes))
        kinds_of.append(kinds)
        lines_of.append(n)
    a = np.array(codes, np.int64)
    # a disguised word is its plain form, whoever else spells that
    plain_of: dict[int, str] = {}
    for i, t in enumerate(list(index)):
        if len(t) > 2 and not t.isalpha() and not t.isdecimal() or not t.isascii() and t.isalpha():
            plain = t.translate(_LEET) if not t.isalpha() else t
            if not plain.isascii() and re.search("[a-z]", plain):
                plain = plain.translate(_LOOKALIKE)
            if plain != t:
                plain_of[i] = plain
                index[plain]  # its own number, if it has none yet
    vocabulary = list(index)
    same_as = np.arange(len(vocabulary))
    disguised = np.zeros(len(vocabulary), bool)
    for i, plain in plain_of.items():
        disguised[i] = True
        same_as[i] = index[plain]
    stop = np.array([not t[0].isalnum() for t in vocabulary], bool)
    asks = np.array([t[0] in ".!?。！？" for t in vocabulary], bool)
    latin = np.array([plain_of.get(i, t) in FUNCTION_WORDS for i, t in enumerate(vocabulary)], bool)
    # numbers, hashes and the like are no words
    number = np.array([t.isdecimal() or len(t) > 12 and any(map(str.isdigit, t)) for t in vocabulary], bool)
    other = np.array([not t.isascii() and bool(_OTHER.search(t)) for t in vocabulary], bool)
    weight = np.array([0.0 if s else _weight(t) + 1 for t, s in zip(vocabulary, stop, strict=True)])
    doc_of_all = np.repeat(np.arange(len(texts)), np.diff([0, *ends]))
    if len(a):
        breaks = stop[a]
        # sentences: a break starts another; a new text too
        first = np.concatenate([[True], doc_of_all[1:] != doc_of_all[:-1]])
        segment_all = np.cumsum(breaks | first)
        ended = np.zeros(segment_all[-1] + 1, bool)
        ended[segment_all[breaks & asks[a]] - 1] = True  # the sentence before this mark has an end
        words = ~breaks
        w, doc, segment = same_as[a[words]], doc_of_all[words], segment_all[words]
        raw = a[words]
        n = len(w)
    if len(a) and n:
        sizes = np.bincount(segment, minlength=len(ended))
        short = (sizes <= _SHORT) & ~ended
        group = np.where(short[segment], -1, segment)
        order = np.argsort(w, kind="stable")
        prev = np.full(n, -1)
        again = w[order][1:] == w[order][:-1]
        prev[order[1:][again]] = order[:-1][again]
        fw, nl, num = latin[raw], other[raw], number[raw]
        ok = (prev >= 0) & (np.arange(n) - prev <= _REACH) & ~fw & ~num
        ok[ok] = (group[ok] == group[prev[ok]]) & (doc[ok] == doc[prev[ok]])
        # twice is a turn of phrase: a word counts once it is there three times in its sentence or five times in its text
        ok &= (_times(order, again, segment) >= 3) | (_times(order, again, doc) >= 5)
        starts = np.searchsorted(doc, np.arange(len(texts)))
        stops = np.searchsorted(doc, np.arange(len(texts)), side="right")
        i = np.arange(n)
        lo, hi = np.maximum(starts[doc], i - _HALF), np.minimum(stops[doc], i + _HALF + 1)

        def around(x: np.ndarray) -> np.ndarray:
            c = np.concatenate([[0], np.cumsum(x)])
            return (c[hi] - c[lo]) / (hi - lo)

        # a whole sentence that repeats nothing and has function words stays sound next to a list
        function_words = np.bincount(segment, weights=fw | nl, minlength=len(ended))
        repeats = np.bincount(segment, weights=ok, minlength=len(ended))
        sound = ended & (repeats == 0) & (function_words > 0.15 * sizes)
        repeated = (around(ok) / np.maximum(1 - around(fw), 0.2) >= 0.28) & ~sound[segment]
        wordy = np.bincount(doc, weights=~num, minlength=len(texts))[doc] >= _LEAST
        bare = (around(fw | nl) < 0.07 * around(~num)) & (around(num) < 0.7) & wordy
        # what the trees see of the words: how they fall over the parts of a page, without the windows above
        in_doc = np.bincount(doc, minlength=len(texts))
        content = ~(fw | nl | num)
        focus = np.where(content, _times(order, again, doc) / in_doc[doc], 0.0)
        fresh = (prev < 0) | (doc[np.maximum(prev, 0)] != doc)
        part = doc * _PARTS + (i - starts[doc]) * _PARTS // in_doc[doc]
        in_part = np.bincount(part, minlength=len(texts) * _PARTS).reshape(-1, _PARTS)

        def quartiles(name: str, x: np.ndarray) -> dict[str, np.ndarray]:
            sums = np.bincount(part, weights=x, minlength=len(texts) * _PARTS).reshape(-1, _PARTS)
            mean = sums.sum(axis=1) / np.maximum(in_doc, 1)
            each = np.sort(np.where(in_part > 0, sums / np.maximum(in_part, 1), mean[:, None]), axis=1)
            return {f"{name}_low": each[:, _PARTS // 4], f"{name}_mid": (each[:, _PARTS // 2 - 1] + each[:, _PARTS // 2]) / 2, f"{name}_high": each[:, -1 - _PARTS // 4]}

        segments = np.bincount(doc[np.concatenate([[True], segment[1:] != segment[:-1]])], minlength=len(texts))
        voting = quartiles("functional", fw | nl) | quartiles("focus", focus) | quartiles("fresh", fresh)
        voting |= {"focus": np.bincount(doc, weights=focus, minlength=len(texts)) / np.maximum(in_doc, 1), "sentence": np.log1p(in_doc / np.maximum(segments, 1))}
        length = weight[raw]
        total = lambda mask: np.bincount(doc, weights=length * mask, minlength=len(texts))
        count = np.maximum(np.bincount(doc, minlength=len(texts)), 1)
        share = lambda mask: np.bincount(doc, weights=mask, minlength=len(texts)) / count
        distinct = np.bincount(doc, weights=fresh, minlength=len(texts)) / count
        columns = {"spam": total(repeated | bare), "repeated": total(repeated), "bare": total(bare), "all": total(np.ones(n))}
        shares = {"functional": share(fw | nl), "distinct": distinct, "digits": share(num), "disguised": share(disguised[raw]), "ended": share(ended[segment])} | voting
    else:
        zero = np.zeros(len(texts))
        columns = dict.fromkeys(("spam", "repeated", "bare", "all"), zero)
        shares = dict.fromkeys(("functional", "distinct", "digits", "disguised", "ended", "focus", "sentence", *(f"{n}_{q}" for n in ("functional", "focus", "fresh") for q in ("low", "mid", "high"))), zero)
    for k, kinds in enumerate(kinds_of):
        whole = columns["all"][k] + sum(kinds.values())
        if whole <= 0:
            continue
        row = {c: columns[c][k] / whole for c in ("spam", "repeated", "bare")} | {c: v / whole for c, v in kinds.items()} | {c: v[k] for c, v in shares.items()}
        row["spam"] += row["links"] + row["tags"]
        row["per_line"] = np.log1p(whole / max(lines_of[k], 1))
        row["size"] = np.log1p(whole)
        linked, link_weight, link_lines, hosts = links_of[k]
        size = max(whole, 1.0)
        row |= {"urls": np.log1p(100 * linked / size), "url_text": min(link_weight / size, 1.0), "url_lines": link_lines / max(lines_of[k], 1), "url_hosts": hosts / max(linked, 1), "marks": np.log1p(100 * marks_of[k][0] / size), "separators": np.log1p(100 * marks_of[k][1] / size)}
        out[k] = [row[c] for c in FEATURES]
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, first, chars = batch.column(3).to_pylist(), 0, 0
        for at, text in enumerate(texts, 1):
            chars += len(text or "")
            if chars >= _PASS_CHARS or at == len(texts):
                rows = features(texts[first:at])
                yield pa.RecordBatch.from_arrays([*batch.slice(first, at - first).columns[:3], pa.array(list(rows), pa.list_(pa.float64()))], ["doc_id", "host", "copy_key", "features"])
                first, chars = at, 0


def page_features(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, host, copy_key, features array<double>) of every page, in one pass over the whole texts."""
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("copy_key"), F.col(text).cast("string").alias("text"))
    return spread(picked).mapInArrow(_read, "doc_id bigint, host string, copy_key string, features array<double>")


def spam_scores(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text", clear: float = 0.6, sound: float = 0.4, sample_rows: int = 50_000, trees: int = 40, depth: int = 12, smoothing: float = 0.5, prior_pages: float = 50.0) -> DataFrame:
    """(doc_id, share, page, host_rate, score): the share of spam read, the trees' probability, the host's shrunk spam rate, and the last two together.

    Pages whose share of spam is at least ``clear`` or at most ``sound`` are weakly labelled;
    at most about ``sample_rows`` of each label train the trees, which see the statistics of
    ``VOTING`` and not the share; all pages are scored.
    ``smoothing`` weighs the host's log odds against the corpus'; ``prior_pages`` shrinks
    the rates of small hosts. Null and blank texts score 0, a null host is a host of its
    own, copies of a text get the highest score among them. Where one label is missing the
    share itself is the trees' probability. Other columns are ignored.
    """
    pages = materialize(page_features(docs, doc_id, host, text))
    share = F.col("features")[0]
    label = F.when(share >= clear, 1.0).when(share <= sound, 0.0)
    seen = array_to_vector(F.slice("features", len(LABELLING) + 1, len(VOTING)))
    known = pages.select("doc_id", "copy_key", "features", label.alias("label")).where("label is not null")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) == 2:
        # a fixed hash of the page keeps about sample_rows of each label, however many copies a text has, in a fixed order
        keep = F.when(F.col("label") == 1.0, min(1.0, sample_rows / counts[1.0])).otherwise(min(1.0, sample_rows / counts[0.0]))
        dice = F.pmod(F.xxhash64("doc_id", "copy_key", F.lit(8)), F.lit(1_000_000)) / 1_000_000.0
        train = known.where(dice < keep).select("label", seen.alias("x"), "doc_id", "copy_key").repartition(4, "doc_id").sortWithinPartitions("doc_id", "copy_key").select("label", "x")
        forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, maxBins=128, seed=8, subsamplingRate=0.7, featureSubsetStrategy="onethird").fit(materialize(train))
        voted = forest.transform(pages.withColumn("x", seen)).withColumn("page", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")
    else:
        voted = pages.withColumn("page", share)
    voted = materialize(voted.select("doc_id", "host", "copy_key", share.alias("share"), F.when(F.col("features")[FEATURES.index("size")] > 0, F.col("page")).otherwise(0.0).alias("page")))
    total = voted.count()
    overall = voted.agg(F.avg(F.round("page")).alias("r")).collect()[0]["r"] or 0.0
    hosts = voted.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.round("page")).alias("bad"))
    rates = hosts.select("host", "n", ((F.col("bad") + prior_pages * overall) / (F.col("n") + prior_pages)).alias("host_rate"))
    joined = hot_aware_join(voted, rates, ["host"], "n", total)
    odds = lambda c: F.log(F.greatest(c, F.lit(1e-3)) / F.greatest(1 - c, F.lit(1e-3)))
    mixed = odds(F.col("page")) + smoothing * (odds(F.col("host_rate")) - odds(F.lit(float(overall))))
    scored = materialize(joined.select("doc_id", "copy_key", "share", "page", "host_rate", F.when(F.col("page") > 0, 1 / (1 + F.exp(-mixed))).otherwise(0.0).alias("score")))
    best = scored.groupBy("copy_key").agg(F.max("score").alias("best"), F.count("*").alias("n"))
    return hot_aware_join(scored, best, ["copy_key"], "n", total).select("doc_id", "share", "page", "host_rate", F.col("best").alias("score"))


def spam_pages(docs: DataFrame, threshold: float = 0.5, **kw) -> DataFrame:
    """(doc_id) of the pages whose score is at least ``threshold``."""
    return spam_scores(docs, **kw).where(F.col("score") >= threshold).select("doc_id").distinct()
