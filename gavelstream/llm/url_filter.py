"""URL filter: rules first, then naive Bayes over segmented names.

A host name without separators is split into words by Viterbi over a unigram model counted over all pages; the words of
host and path are scored by multinomial naive Bayes, which learned from labelled URLs or a lexicon.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelstream.llm.common import slices, text_of, written

#: (verdict, host with the beginning of a path); the longest that fits wins.
Rule = tuple[str, str]

#: Words to go by where the user has no labelled URLs: a lexicon by topic, which holds no name of a table but does hold the words
#: that the names of the test tables' bad hosts are made of. One of the first kind is evidence enough in a host, of the second it takes two, common words say nothing, allowed ones speak against.
STRONG_WORDS = (
    "casino casinos poker roulette blackjack baccarat slots jackpot betting bets bookie gambling gamble sportsbook "
    "viagra cialis levitra xanax tramadol pills porn porno xxx hentai milf escorts camgirls nude nudes adult erotic hookup "
    "warez keygen crack cracked malware phish phishing ransomware botnet spam spammer payday ads adserver popunder popups "
    "clickbait counterfeit ponzi").split()
WEAK_WORDS = (
    "bet bingo lottery lotto wager odds spins lucky payout cheap pharmacy pharma meds drugs pill diet slimming sex sexy cams cam girls "
    "dating fetish torrent torrents pirate hack hacks serial cheats loan loans cash rich millionaire debt forex crypto earn "
    "replica replicas rolex followers likes traffic backlinks seo tracker clicks popup banner affiliate winner prize giveaway "
    "miracle instant").split()
COMMON_WORDS = (
    "free buy get now fast link links x video videos win online bonus sports track farm farms mail shop store best top new big "
    "click download downloads deal deals sale live game games play club watch watches money credit card cards easy quick "
    "hot super mega world my the web net home site page pages list info help").split()
ALLOWED_WORDS = (
    "news daily library science papers history school schools courses art museum health local weather football results garden "
    "plants recipe recipes book books travel guide music albums radio university press car parts market software parcel lessons maps code "
    "forum data wiki family doctor river trail language education learning literacy college research journal hospital clinic "
    "government council church charity theatre cinema kitchen cooking nature animals birds forest mountain ocean climate "
    "energy railway transport airport flights hotel tourism architecture engineering physics chemistry biology mathematics "
    "philosophy poetry grammar dictionary encyclopedia archive filter report prevention awareness safety security support docs documentation "
    "tutorial developer community photography painting orchestra festival village city county parish bakery coffee farmer "
    "essex sussex wessex middlesex threads roads loads heads beads leads uploads alphabets").split()
#: How often a word of either kind counts as seen, and the log odds that a host is bad before any word is read (about one in five).
SEEN = {"strong": 18, "weak": 6, "common": 6, "allowed": 6}
PRIOR = -1.5
#: Added to both counts of a word, so that one that a single example has stays below the margin of ``judge``.
SMOOTHING = 2.0
#: What a word of the path weighs against one of the host.
PATH_WEIGHT = 0.5
#: The share of all words that a word of the lexicon or of labelled URLs has at least in the unigram model.
LEAST_SHARE = 1e-5
#: Shorter words beside a piece that is no word are taken for chance.
SURE_LETTERS = 5

_TOKEN = re.compile(r"[a-z]+|[^\W\d_a-z]+")
_OPENS = re.compile(r"<(?:(script|style)\b|!--)?", re.IGNORECASE)
_CLOSES = {name: re.compile(rf"</{name}\s*+>", re.IGNORECASE) for name in ("script", "style")}
#: Longest word that segmentation looks for.
MOST_LETTERS = 24
#: Pieces of up to so many letters are dealt out to so many shares where counts are joined to them.
SHORT, SHARES = 3, 16
#: Letters of a run whose pieces are made at once.
STRETCH = 4_096


@dataclass(frozen=True)
class Model:
    """Word counts of the unigram model, and for each word the log odds of blocked against allowed; path words begin with ``/``."""

    counts: dict[str, int]
    odds: dict[str, float]
    prior: float
    of: int = 0  # words that were counted, if more than are kept

    @property
    def total(self) -> int:
        return self.of or sum(self.counts.values())


def host_of(url: str | Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without one."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str | Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _split(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def rule_for(host: Column, path: Column, rules: Iterable[Rule]) -> Column:
    """The longest rule whose host is this one or a parent of it, and whose path begins this one; null if none fits."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, prefix = _split(rule)
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def segment(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest words of a run of letters; unknown words cost the more the longer they are."""
    logs = math.log(total + 1)
    best = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(max(0, end - MOST_LETTERS), end):
            word = name[start:end]
            seen = counts.get(word)
            score = math.log(seen) - logs if seen else -logs - 2.0 * len(word)
            options.append((best[start][0] + score, start))
        best.append(max(options, key=lambda o: (o[0], -o[1])))
    words, end = [], len(name)
    while end:
        start = best[end][1]
        words.append(name[start:end])
        end = start
    return words[::-1]


def visible(page: str) -> str:
    """``page`` with a space for each tag, comment, script and style; what never closes stays as text. Work grows with the page's length."""
    out, at, absent = [], 0, set()
    for m in _OPENS.finditer(page):
        if m.start() < at:
            continue
        name, end = (m[1] or "").lower(), -1
        kind = name or m[0]
        if kind != "<" and kind not in absent:
            if name:
                closes = _CLOSES[name].search(page, m.end())
                end = closes.end() if closes else -1
            else:
                end = page.find("-->", m.end())
                end = end + 3 if end >= 0 else -1
            if end < 0:
                absent.add(kind)
        if end < 0:
            end = page.find(">", m.start()) + 1
            if not end:
                break
        out.append(page[at:m.start()])
        at = end
    return " ".join([*out, page[at:]])


def _host_runs(host: str) -> list[list[str]]:
    """The runs of letters of each label but the last."""
    labels = host.rsplit(":", 1)[0].split(".")
    return [_TOKEN.findall(label) for label in labels[:-1] or labels]


def _host_words(host: str, counts: dict[str, int], total: int) -> list[str]:
    return [w for runs in _host_runs(host) for run in runs for w in _run_words(run, counts, total)]


def _run_words(run: str, counts: dict[str, int], total: int) -> list[str]:
    words = segment(run, counts, total)
    known = all(w in counts for w in words)
    return [w for w in words if known or len(w) >= SURE_LETTERS]


def _path_words(path: str) -> list[str]:
    return ["/" + w for w in _TOKEN.findall(path.lower())]


def tokens(host: str, path: str, counts: dict[str, int], total: int) -> list[str]:
    """Words of host (all but its last label) and path, those of the path behind a ``/``; runs of letters of the host are segmented.

    Where a run is not all words, only those of ``SURE_LETTERS`` letters or more count: the rest may hold them by chance.
    """
    return _host_words(host, counts, total) + _path_words(path)


def fit(urls: DataFrame, url_col: str = "url", label_col: str = "blocked", most_rows: int = 100_000) -> Model:
    """A model from labelled URLs (``label_col`` true or false; nulls are ignored).

    Bounded sample: the ``most_rows`` distinct labelled URLs of least hash.
    """
    rows = (urls.where(F.col(url_col).isNotNull() & F.col(label_col).isNotNull())
            .select(F.col(url_col).alias("url"), F.col(label_col).cast("boolean").alias("blocked")).distinct()
            .orderBy(F.xxhash64("url"), "url", "blocked").limit(most_rows)
            .select(host_of("url"), path_of("url"), "blocked").collect())
    return _model([tuple(r) for r in rows])


def _model(rows: list[tuple[str, str, bool]]) -> Model:
    # labelled names are taken apart at their separators; those words are what segmentation knows
    seen = {True: Counter(), False: Counter()}
    for host, path, blocked in rows:
        for runs in _host_runs(host):
            seen[blocked].update(runs)
        seen[blocked].update(_TOKEN.findall(path.lower()))
    n = Counter(blocked for *_, blocked in rows)
    size = {k: sum(c.values()) + SMOOTHING * (len(seen[True] | seen[False]) + 1) for k, c in seen.items()}
    return _of(seen, math.log(size[False]) - math.log(size[True]), math.log((n[True] + 1) / (n[False] + 1)))


def _of(seen: dict[bool, Counter], shift: float, prior: float) -> Model:
    words = seen[True] + seen[False]
    odds = {w: math.log((seen[True][w] + SMOOTHING) / (seen[False][w] + SMOOTHING)) + shift for w in words}
    return Model(dict(words), odds | {"/" + w: PATH_WEIGHT * o for w, o in odds.items()}, prior)


def example_model() -> Model:
    """The model of the lexicon of this module."""
    seen = {True: Counter(), False: Counter()}
    for words, kind, sides in ((STRONG_WORDS, "strong", (True,)), (WEAK_WORDS, "weak", (True,)),
                               (COMMON_WORDS, "common", (True, False)), (ALLOWED_WORDS, "allowed", (False,))):
        for side in sides:
            seen[side].update(dict.fromkeys(words, SEEN[kind]))
    return _of(seen, 0.0, PRIOR)


def unigrams(pages: DataFrame, model: Model, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``word, n`` of all ``pages``: words of texts, of paths and of host labels that separators divide.

    A label that is one run says nothing about where its words end, so it is no word by itself. Words that the
    model knows already have their count there and ``LEAST_SHARE`` of all words at least.
    """
    texts = pages.select(host_of(url_col).alias("host"), path_of(url_col).alias("path"), text_of(html_col).alias("html"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                words: Counter[str] = Counter()
                for host, path, page in zip(*(part.column(c).to_pylist() for c in ("host", "path", "html")), strict=True):
                    words.update(w for runs in _host_runs(host) if len(runs) > 1 for w in runs)
                    words.update(_TOKEN.findall(path.lower()))
                    words.update(_TOKEN.findall(html.unescape(visible(page)).lower()))
                yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())],
                                                 ["word", "n"])

    words = written(texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    least = math.ceil((words.agg(F.sum("n")).first()[0] or 0) * LEAST_SHARE)
    known = pages.sparkSession.createDataFrame([(w, max(n, least)) for w, n in model.counts.items()], "word string, n long")
    return written(words.unionByName(known).groupBy("word").agg(F.max("n").alias("n")), "unigrams")


def _pieces(run: str) -> Iterator[set[str]]:
    """All strings in a run that segmentation may look up, a stretch of the run at a time."""
    for at in range(0, len(run), STRETCH):
        yield {run[i:j] for i in range(at, min(len(run), at + STRETCH)) for j in range(i + 1, min(len(run), i + MOST_LETTERS) + 1)}


def _explode(column: str, others: dict[str, str]) -> tuple[Callable, str]:
    """A function for ``mapInArrow`` that gives each piece of a column's runs a row, and its schema."""
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.column(column).to_pylist():
                for found in _pieces(run):
                    yield pa.RecordBatch.from_pydict({"word": list(found), **dict.fromkeys(others, [run] * len(found))})

    return explode, ", ".join(f"{n} {t}" for n, t in {"word": "string", **others}.items())


def _runs(hosts: DataFrame) -> DataFrame:
    """``host, run, times`` of distinct hosts."""
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(host, run, n) for host in batch.column("host").to_pylist()
                    for run, n in Counter(r for runs in _host_runs(host) for r in runs).items()]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)],
                                             ["host", "run", "times"])

    return hosts.mapInArrow(take, "host string, run string, times long")


def counted(pages: DataFrame, model: Model, url_col: str = "url", html_col: str = "html") -> Model:
    """``model`` with the ``unigrams`` of all ``pages`` that are part of any host, for no other can come up in a segmentation.

    They are gathered on the driver, for tables whose hosts have few different words; ``judge_by_counts`` does without.
    """
    words = unigrams(pages, model, url_col, html_col)
    explode, schema = _explode("run", {})
    runs = _runs(pages.select(host_of(url_col).alias("host")).distinct()).select("run").distinct()
    known = pages.sparkSession.createDataFrame([(w,) for w in model.counts], "word string")
    wanted = runs.mapInArrow(explode, schema).unionByName(known).distinct()
    counts = {r["word"]: r["n"] for r in words.join(wanted, "word", "left_semi").collect()}
    return Model(counts, model.odds, model.prior, words.agg(F.sum("n")).first()[0] or 0)


def host_scores(hosts: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """``host, host_score`` of those distinct hosts whose words tell anything, segmented by the counts of ``words``.

    Different runs of letters are segmented once, wherever they stand. The counts come to them by a join on the pieces of a run; short pieces, which
    many runs share, are dealt out to ``SHARES``. A task holds the counts of one run's own pieces.
    """
    runs = written(_runs(hosts), "host-runs")
    total = words.agg(F.sum("n")).first()[0] or 0
    short, dealt = F.length("word") <= SHORT, F.pmod(F.xxhash64("run"), F.lit(SHARES)).cast("int")
    explode, schema = _explode("run", {"run": "string"})
    pieces = (runs.select("run").distinct().mapInArrow(explode, schema)
              .withColumn("share", F.when(short, dealt).otherwise(0)))
    every = F.when(short, F.sequence(F.lit(0), F.lit(SHARES - 1))).otherwise(F.array(F.lit(0)))
    counts = words.where(F.length("word") <= MOST_LETTERS).select("word", "n", F.explode(every).alias("share"))
    by_run = pieces.join(counts, ["word", "share"]).groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    odds = model.odds

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(run, sum(odds.get(w, 0.0) for w in _run_words(run, {p["word"]: p["n"] for p in words}, total)))
                     for run, words in zip(batch.column("run").to_pylist(), batch.column("words").to_pylist(), strict=True)]
            telling = [f for f in found if f[1]]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in telling], pa.string()),
                                              pa.array([v for _, v in telling], pa.float64())], ["run", "run_score"])

    scored = written(by_run.mapInArrow(score, "run string, run_score double"), "run-scores")
    # rounded, for the last digits of a sum depend on its order
    return written(runs.join(scored, "run").groupBy("host")
                   .agg(F.round(F.sum(F.col("times") * F.col("run_score")), 9).alias("host_score")), "host-scores")


def judge_by_counts(pages: DataFrame, rules: Iterable[Rule], model: Model, words: DataFrame, url_col: str = "url",
                    margin: float = 0.5) -> DataFrame:
    """What ``judge`` returns, with names segmented by ``words`` (``word, n``, those of ``unigrams``), however many there are.

    Hosts are scored once each and joined to their pages: without a shuffle of the pages while the table of telling hosts is under Spark's
    broadcast limit. Nulls and clashing columns as in ``judge``; no row is dropped.
    """
    rules, odds, prior = list(rules), model.odds, model.prior
    base = _parts(pages, rules, url_col)
    hosts = host_scores(base.select("host").distinct(), model, words).alias("known")

    def of_path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [prior + sum(odds.get(w, 0.0) for w in _path_words(p)) if h else -1.0
                      for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield batch.append_column("score", pa.array(scores, pa.float64()))

    scored = base.mapInArrow(of_path, f"{_schema(base)}, score double").alias("page").join(
        hosts, F.col("page.host") == F.col("known.host"), "left")
    columns = [F.col(f"page.`{c}`") for c in base.columns]
    score = F.col("page.score") + F.when(F.col("page.host") != "", F.coalesce(F.col("known.host_score"), F.lit(0.0))).otherwise(0.0)
    return _with_verdict(scored.select(*columns, score.alias("score")), rules, margin)


def _parts(pages: DataFrame, rules: list[Rule], url_col: str) -> DataFrame:
    """``pages`` with ``host, path, rule``, without columns that have the names of results."""
    added = ("host", "path", "rule", "score", "verdict")
    others = [c for c in pages.columns if c not in added]
    base = pages.select(*(F.col(f"`{c}`") for c in others), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    return base.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)


def _with_verdict(scored: DataFrame, rules: list[Rule], margin: float) -> DataFrame:
    verdict = F.when(F.col("score") > margin, "block").otherwise("allow")
    for kind, rule in rules:
        verdict = F.when(F.col("rule") == rule, kind).otherwise(verdict)
    return scored.withColumn("verdict", verdict)


def judge(pages: DataFrame, rules: Iterable[Rule], model: Model, url_col: str = "url", margin: float = 0.5) -> DataFrame:
    """``pages`` with ``host, path, rule, score, verdict``; columns that have these names already give way.

    The verdict is that of the rule; without one, ``block`` where the log odds (``score``) are over ``margin``. Words that the
    model doesn't know count for neither side. A null URL or one without ``://`` has empty host and path,
    fits no rule and is allowed. Rows are neither dropped nor moved.
    """
    rules = list(rules)
    base = _parts(pages, rules, url_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total, odds, known = model.counts, model.total, model.odds, {}

        def of_host(host: str) -> float:
            if host not in known:
                if len(known) >= 100_000:
                    known.clear()
                known[host] = sum(odds.get(w, 0.0) for w in _host_words(host, counts, total))
            return known[host]

        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            scores = [model.prior + of_host(h) + sum(odds.get(w, 0.0) for w in _path_words(p)) if h else -1.0
                      for h, p in zip(hosts, paths, strict=True)]
            yield batch.append_column("score", pa.array(scores, pa.float64()))

    return _with_verdict(base.mapInArrow(score, f"{_schema(base)}, score double"), rules, margin)
