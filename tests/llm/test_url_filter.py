"""Parts of URLs, rules, segmentation and the words' verdict."""

import collections
import functools
import itertools
import math
import random
import re
import time

import pytest
import regex
from llm_support import clashing
from pyspark.sql import functions as F

from gavelstream.llm import queries
from gavelstream.llm import url_filter as u


@pytest.mark.parametrize("url, host, path", [
    (None, "", ""), ("", "", ""), ("example.com/a", "", ""), ("http://Ex.COM", "ex.com", ""), ("x://a.b/c?d#e", "a.b", "/c"),
    ("http://a?q=/x", "a", ""), ("http://a#/x", "a", ""), ("http:///p", "", "/p"), ("http://É.com/Ü/\nz", "É.com", "/Ü/\nz"),
    ("u://h://x/y", "h:", "//x/y"), ("see\nhttp://a.org/en/1", "a.org", "/en/1")])
def test_host_and_path(spark, url, host, path):
    df = spark.createDataFrame([(url,)], "url string").select(u.host_of("url"), u.path_of("url"))
    assert tuple(df.first()) == (host, path)


@pytest.mark.parametrize("url, rule, verdict", [
    ("http://a.example.org/es/x", "example.org/es/", "block"), ("http://example.org/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "org/", "allow"), ("http://cheap-pills.org/", "org/", "allow"), ("http://org/", "org/", "allow"),
    ("http://notexample.org/es/", "org/", "allow"), ("http://x.com/fr/", "com/fr/", "allow"), ("http://x.com/de/1", "com/de/", "block"),
    ("http://xcom/de/", None, "allow"), ("http://example.org", None, "allow"), ("http://free-bets.net/en/1", None, "block"),
    ("http://www.spamfarm.net", None, "block"), ("http://blog.tionble.net/fr/1.html", None, "allow"), (None, None, "allow")])
def test_verdicts(spark, url, rule, verdict):
    df = spark.createDataFrame([(1, url)], "page_id long, url string")
    r = u.judge(clashing(df), queries.RULES, u.example_model()).first()
    assert (r.rule, r.verdict) == (rule, verdict)


def test_segmentation_is_the_likeliest_one():
    counts = {"cheap": 4, "pills": 3, "pill": 2, "s": 1, "che": 1, "apple": 2, "app": 2}
    total = sum(counts.values())

    def cost(words):
        return sum(math.log(counts[w]) - math.log(total + 1) if w in counts else -math.log(total + 1) - 2.0 * len(w) for w in words)

    for name in ("cheappills", "pillscheap", "applepills", "xyz", "chepills"):
        every = []
        for cuts in itertools.product([0, 1], repeat=len(name) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(name)]
            every.append([name[a:b] for a, b in zip(at, at[1:])])
        assert abs(cost(u.segment(name, counts, total)) - max(map(cost, every))) < 1e-9
    assert u.segment("cheappills", counts, total) == ["cheap", "pills"] and u.segment("", counts, total) == []


def test_model_from_labelled_urls(spark):
    rows = [(f"http://{a}{b}.com/x", True) for a in ("gamble", "wager") for b in ("-now", "-fast")]
    rows += [(f"http://{a}-{b}.com/x", False) for a in ("river", "stone") for b in ("house", "path")] + [(None, True), ("http://q.com", None)]
    model = u.fit(spark.createDataFrame(rows, "url string, blocked boolean"), most_rows=100)
    assert set(model.counts) == {"gamble", "wager", "now", "fast", "river", "stone", "house", "path", "x"}
    pages = spark.createDataFrame([(1, "http://gamblefast.net/x"), (2, "http://riverhouse.net/x")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in u.judge(pages, [], model).collect()} == {1: "block", 2: "allow"}


def test_whole_table_against_plain_rules(spark):
    got = queries.op8_urls(spark, "/root/testdata/sf0.001").collect()
    pages = {r.page_id: r.url for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    assert len(got) == len(pages)
    model = u.example_model()
    for r in got:
        rest = pages[r.page_id].split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        path = rest[end:].split("?")[0].split("#")[0]
        assert (r.host, r.path) == (rest[:end].lower(), path)
        fits = [(len(rule), rule, kind) for kind, rule in queries.RULES
                if f".{r.host}".endswith("." + rule.split("/")[0]) and path.startswith(rule[rule.index("/"):])]
        score = model.prior + sum(model.odds.get(w, 0) for w in u.tokens(r.host, path, model.counts, model.total))
        expected = max(fits)[1:] if fits else (None, "block" if score > 0.5 else "allow")
        assert (r.rule, r.verdict) == expected


def test_rows(spark):
    pages = spark.createDataFrame([(1, None), (1, None), (None, "http://a.net/" + "q/" * 100_000)], "page_id long, url string")
    out = u.judge(pages.withColumn("host", F.lit("old")).withColumn("verdict", F.lit(1)), queries.RULES, u.example_model())
    assert out.count() == 3 and {r.verdict for r in out.collect()} == {"allow"}
    assert u.judge(pages.limit(0), queries.RULES, u.example_model()).count() == 0


#: Names that are no word of the lexicon. These came up along with it, by the same hand, so they are held out as names only;
#: the later ones were made when the lexicon was done, and it has not changed since.
BAD_NAMES = (
    "luckyroulette grandpokerroom onlinecasinobonus royal-blackjack bestsportsbook megajackpotslots betting-tips-daily free-spins-casino viagra-express "
    "buycialisnow xanax-shop diet-pills-fast cheapmeds pornhouse xxxmovies nudecams hotgirlscams adulthookup sexdating erotic-stories warezworld "
    "keygen-archive crackedgames phishing-kit botnetrental paydayloans instantcashloans cryptogiveaway replicarolex cheap-followers "
    "buybacklinks popunder-network spammer-tools torrentpirate lotterywinner millionaireforex serialhacks ransomware-store escortsguide").split()
CLEAN_NAMES = (
    "fastmail getty videolan getaway buyer-guide linksgolf nowtoronto winchester freebsd farmers-weekly trackmania "
    "cardiff-council adulteducation spamfilter luckyluke cheapflights cityhospital poetryarchive sexeducation onlinelearning weathermaps "
    "gamesradar cashew betterhomes slotmachinehistory clubpenguin mediawiki stackoverflow bakerycoffee villagechurch datingscience "
    "railwaymuseum hotelreviews watchmaker oceanography tibetanbooks").split()
LATER_BAD = (
    "vegasspins hotslotsbonus winbigpoker bitcoin-doubler fakewatches essaywriters weightlossmiracle sexshopdirect livecamsex hornysingles "
    "rxmedsonline genericviagra noprescriptionmeds moviepirates freecracksoftware passwordstealer keyloggerpro quickloansnow "
    "binaryoptionsprofit clickfraudbot").split()
LATER_CLEAN = (
    "botanicgarden analyticsweekly grassroots therapist bassexpert specialists expertsexchange scunthorpe cocktails padstow breadmaking "
    "spinstitch betaversion alphabetsoup loanword pillowtalk seoulguide camera-shop cashmere forexample hackathon dieticians oddsandends "
    "bankofengland serialpodcast camping adsorption crackerbarrel spamalot casinoroyalereview").split()


def verdicts(spark, urls, model):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    return {urls[r.page_id]: r.verdict for r in u.judge(df, [], model).collect()}


def test_rates_on_names_held_out(spark):
    model = u.counted(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), u.example_model())
    for m in (model, u.example_model()):
        rates = []
        for names in (BAD_NAMES, CLEAN_NAMES, LATER_BAD, LATER_CLEAN):
            got = verdicts(spark, [f"https://www.{n}.net/en/1" for n in names], m)
            rates.append(sum(v == "block" for v in got.values()) / len(got))
        print(rates)  # of the later bad ones, most are allowed: their words are not in the lexicon
        assert rates[0] >= 0.7 and rates[1] <= 0.05 and rates[3] <= 0.1
        assert not {*BAD_NAMES, *CLEAN_NAMES, *LATER_BAD, *LATER_CLEAN} & m.odds.keys()


def test_one_common_word_blocks_nothing(spark):
    urls = [f"https://www.example.net/en/{w}/1.html" for w in ("videos", "buy", "get", "now", "fast", "links", "x", "casino")]
    urls += ["https://x.net/", "https://fastmail.com/", "https://getty.edu/", "https://cheap.net/"]
    assert set(verdicts(spark, urls, u.example_model()).values()) == {"allow"}
    rows = [("http://rare-casino.com/", True), ("http://lone-river.com/", False)]
    fitted = u.fit(spark.createDataFrame(rows, "url string, blocked boolean"))
    assert set(verdicts(spark, ["http://rare.net/"], fitted).values()) == {"allow"}


def test_unigrams_are_those_of_all_pages(spark):
    pages = [("http://big-stonehouse.net/old/1", "<p>Stone &amp; stone <script>house</script><b class='stone'>stone</b> house of cards</p>")] * 3
    model = u.counted(spark.createDataFrame([*pages, (None, None)], "url string, html string").repartition(2), u.example_model())
    assert (model.counts["stone"], model.counts["house"], model.counts["stonehouse"], model.counts["big"]) == (9, 3, 3, 12)
    assert "cards" in model.counts and "of" not in model.counts and model.counts["casino"] == 18
    assert "lexicon" not in model.counts and u.segment("bighouse", model.counts, model.total) == ["big", "house"]


@pytest.mark.parametrize("page, text", [
    ("a<b>c<!-- d <e> -->f<SCRIPT x>g<h></script >i<style>j</style>k", "a c f i k"),
    ("<!--a>b<script>c</style><f", " b c <f"), ("<scripts>a</scripts>", " a "), ("", ""), ("a > b", "a > b"),
])
def test_visible_text(page, text):
    assert u.visible(page) == text


@pytest.mark.parametrize("page", ["<!--" * 80_000, "<script>" * 40_000, "<style " * 40_000, "<" * 300_000, "<!-- <script>x" * 20_000])
def test_work_grows_with_the_length_of_broken_pages(page):
    started = time.perf_counter()
    u.visible(page)
    assert time.perf_counter() - started < 5


def random_pages(spark):
    rng = random.Random(11)
    words = [*"cheap casino river stone house bet bets free farm mail the a é naïve ünder".split(), *u.STRONG_WORDS[:8]]
    urls = [None, "", "no-url", "http://", "http:///x", "http://a", "http://" + "casino" * 300 + ".net/"]
    for _ in range(300):
        labels = ["".join(rng.choices(words, k=rng.randrange(1, 4))) if rng.random() < 0.7 else "-".join(rng.choices(words, k=2))
                  for _ in range(rng.randrange(1, 4))]
        urls.append(f"https://{rng.choice(['www.', 'm.', ''])}{'.'.join(labels)}.net:80/{'/'.join(rng.choices(words, k=2))}")
    rows = [(i, url, " ".join(rng.choices(words, k=9)) if i % 3 else None) for i, url in enumerate(urls * 2 + urls[-1:] * 300)]
    return spark.createDataFrame(rows, "page_id int, url string, html string").repartition(5)


def plain_words(run, counts, total):
    """The words of a run that count, by trying where the last word begins, from the front."""
    @functools.lru_cache(None)
    def best(end):
        if not end:
            return 0.0, ()
        found = None
        for start in range(max(0, end - 24), end):
            cost, words = best(start)
            word = run[start:end]
            cost += math.log(counts[word] / (total + 1)) if word in counts else -math.log(total + 1) - 2.0 * len(word)
            if found is None or cost > found[0] + 1e-9:
                found = cost, (*words, word)
        return found

    for end in range(len(run)):
        best(end)
    words = best(len(run))[1]
    return [w for w in words if len(w) >= 5 or all(x in counts for x in words)]


def test_verdicts_with_the_counts_of_all_pages_against_plain_ones(spark):
    """As the query judges: counts, segmentation and sums done over in plain Python."""
    pages, model = random_pages(spark), u.example_model()
    got = u.judge_by_counts(pages, queries.RULES, model, u.unigrams(pages, model)).collect()
    rows = pages.collect()
    counts = collections.Counter()
    split = {}
    for r in rows:
        rest = (r.url or "").partition("://")[2]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host):])[0]
        runs = [regex.findall(r"[a-z]+|[\p{L}--[a-z]]+", label, flags=regex.V1) for label in host.lower().split(":")[0].split(".")[:-1]
                or [host.lower()]]
        split[r.page_id] = host.lower(), path, runs
        counts.update(w for label in runs if len(label) > 1 for w in label)
        for text in (path, r.html or ""):
            counts.update(regex.findall(r"[a-z]+|[\p{L}--[a-z]]+", text.lower(), flags=regex.V1))
    least = math.ceil(sum(counts.values()) * 1e-5)
    for word, n in model.counts.items():
        counts[word] = max(counts[word], n, least)
    total = sum(counts.values())
    assert len(got) == len(rows)
    blocked = 0
    known = {}
    for r in got:
        host, path, runs = split[r.page_id]
        if host not in known:
            known[host] = sum(model.odds.get(w, 0) for label in runs for run in label for w in plain_words(run, counts, total))
        score = model.prior + known[host] + sum(
            model.odds.get("/" + w, 0) for w in regex.findall(r"[a-z]+|[\p{L}--[a-z]]+", path.lower(), flags=regex.V1)) if host else -1.0
        assert (r.host, r.path) == (host, path) and abs(r.score - score) < 1e-6
        blocked += r.verdict == "block"
        assert r.rule is None and r.verdict == ("block" if score > 0.5 else "allow")
    assert 30 < blocked < len(rows) - 30


def test_joined_counts_give_the_verdicts_of_gathered_ones(spark):
    pages, model = spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), u.example_model()
    joined = queries.op8_urls(spark, "/root/testdata/sf0.001")
    gathered = u.judge(pages, queries.RULES, u.counted(pages, model)).select(joined.columns)
    assert sorted(map(str, joined.collect())) == sorted(map(str, gathered.collect()))


def test_rows_by_counts(spark):
    pages = spark.createDataFrame([(1, None), (1, None), (None, "http://a.net/" + "q/" * 1_000)], "page_id long, url string")
    clash = pages.withColumn("host", F.lit("old")).withColumn("verdict", F.lit(1)).withColumn("host_score", F.lit("x")).withColumn(
        "scored_host", F.lit("y"))
    model = u.example_model()
    words = u.unigrams(pages.withColumn("html", F.lit(None).cast("string")), model)
    out = u.judge_by_counts(clash, queries.RULES, model, words)
    assert out.count() == 3 and {r.verdict for r in out.collect()} == {"allow"}
    assert {r.host_score for r in out.collect()} == {"x"} and {r.host for r in out.collect()} == {"", "a.net"}
    assert u.judge_by_counts(pages.limit(0), queries.RULES, model, words).count() == 0
