"""Mixtures, URL filters and quality rules: table operators without Python on the executors."""

import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tonemill.llm import mixing, quality_rules, queries, url_filter


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 1, "b": 1}, {"a": 4, "b": 1, "c": 1}, {"a": 7, "b": 5, "c": 3, "d": 11, "e": 1}])
def test_every_source_stays_within_a_block(weights):
    period = sum(weights.values())
    rows = mixing.pfair_period(weights)
    assert [r[4] for r in rows] == list(range(period))
    done = Counter()
    for source, weight, nth, release, slot in rows * 1:
        assert nth == done[source] and release <= slot < -(-(nth + 1) * period // weight)
        done[source] += 1
        for s, w in weights.items():
            assert abs(done[s] - Fraction((slot + 1) * w, period)) < 1
    assert done == weights


def test_mix_keeps_all_rows_and_the_shares(spark, odd_docs, no_docs):
    rnd = random.Random(1)
    rows = [(i, "x" * rnd.randint(0, 300), "big" if i % 3 else f"s{i % 4}") for i in range(1_500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, {"big": 2}, block_chars=1_000).collect()
    assert sorted(r.doc_id for r in got) == list(range(1_500))
    per_source = {}
    for r in sorted(got, key=lambda r: (r.source, r.start, r.turn, r.text_hash)):
        assert per_source.get(r.source, 0) == r.start and r.block == r.start // 1_000
        per_source[r.source] = r.start + r.n_chars
    weights, period = {"big": 2, "s0": 1, "s1": 1, "s2": 1, "s3": 1}, 6
    ends = min(max(r.block for r in got if r.source == s) * period // w for s, w in weights.items())
    for slot in range(0, ends):
        blocks = Counter(r.source for r in {(r.source, r.block): r for r in got if r.slot <= slot}.values())
        assert all(abs(blocks[s] - (slot + 1) * w / period) < 1 for s, w in weights.items())
    odd = mixing.mix(odd_docs, {None: 2, "s0": 1}, block_chars=50).collect()
    assert len(odd) == 14 and {r.source for r in odd} == {None, "s0", "s1"}
    assert mixing.mix(no_docs, {}, 100).count() == 0
    ordered = mixing.in_mixed_order(odd_docs, {}, 50)
    assert ordered.columns == odd_docs.columns and sorted(map(str, ordered.collect())) == sorted(map(str, odd_docs.collect()))
    with pytest.raises(ValueError, match="slots"):
        mixing.pfair_period({"a": mixing.MAX_PERIOD + 1})


def test_runs_of_a_source_do_not_change_the_blocks(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 50), "one") for i in range(400)], "doc_id long, text string, source string")
    few, many = (sorted(mixing.in_blocks(docs, 500, fan=f).select("doc_id", "start", "block").collect()) for f in (1, 4096))
    assert few == many


URLS = [
    None, "", "no scheme/path", "http://", "://x.org/a", "HTTP://Blog.Example.ORG/es/1?x#y", "http://example.org/en/1", "http://example.org/en/12/3",
    "http://example.org/EN/1", "http://notexample.org/es/", "https://a.org", "https://a.org?x=/de/", "https://b.com/fr/9", "https://b.com/de/9#", "http://com/de/",
    "https://www.casino-win.example.net/en/1", "https://www.casino-win.example.net/help/", "https://acasino-x.net/", "https://x.net/ads/1.png", "https://x.net/uploads/1",
    "https://x.net/a?utm_campaign=spam&x", "https://x.net/tracking/pixel", "https://x.net/tracking/pixels", "https://x.net/sponsored/a/b.html?z", "https://cheap-pills.x.net/", "http://a\nb.net/ads/x",
]


def plain_judgement(url, hosts, patterns):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    lower = "".join(c.lower() if c.isascii() else c for c in url or "")
    host, path = ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")
    fits = [r for r in hosts if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.name))
        return host, path, best.name, best.verdict
    verdicts = {p.verdict for p in patterns if m and re.search(p.regex, lower)}
    return host, path, None, "allow" if "allow" in verdicts or not verdicts else "block"


def test_urls_against_all_rules(spark, only_shuffles):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, URLS[7], "", ""), (3, URLS[15], "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    patterns = [*queries.PATTERN_RULES, url_filter.PatternRule("block", "pixels")]  # one without a whole token
    got = url_filter.filter_urls(pages, queries.HOST_RULES, patterns)
    want = [(i, *plain_judgement(u, queries.HOST_RULES, patterns)) for i, u, _, _ in rows]
    assert sorted(map(str, [tuple(r)[:5] for r in got.collect()])) == sorted(map(str, want))
    assert {w[4] for w in want} == {"allow", "block"}
    assert url_filter.filter_urls(pages.limit(0), queries.HOST_RULES, patterns).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    rule = url_filter.PatternRule("block", "||ads.example^*/banner/x")
    assert rule.tokens == ["ads", "banner", "example"]
    assert url_filter.PatternRule("block", "part*whole/part").tokens == []
    urls = spark.createDataFrame([("http://ads.example/banner",), ("http://ads.example/",), ("http://example/banner",)], "url string")
    assert url_filter.rule_index(urls, url_filter.rule_table(spark, [rule])).first()["token"] == "ads"


def plain_counts(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed)


@pytest.fixture(scope="module")
def mixed_texts():
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(12)]
    texts = [" ".join(rnd.choice(vocabulary[: rnd.randint(1, 12)]) for _ in range(rnd.randint(0, 60))) for _ in range(150)]
    texts += ["\n".join(rnd.choice(["a b", "a b ", "", " ", "c"]) for _ in range(rnd.randint(0, 9))) for _ in range(50)]
    return [*texts, None, "", "a\x0b\x0cb\r c", "###" * 20_000, "😀 " * 30, "x" * 100_000]


def test_statistics_and_base(spark, mixed_texts, odd_docs, odd_rows):
    docs = spark.createDataFrame(list(enumerate(mixed_texts)), "doc_id long, text string")
    stats = quality_rules.text_statistics(docs).withColumn("failed", quality_rules.base_failed())
    got = {r.doc_id: tuple(r[c] for c in [*quality_rules.COUNTS, "failed"]) for r in stats.collect()}
    assert got == {i: plain_counts(t) for i, t in enumerate(mixed_texts)}
    odd = quality_rules.text_statistics(odd_docs).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in odd) == sorted((i or 0, plain_counts(t)[0]) for i, t in odd_rows)


def test_rules_are_learned_and_applied_in_order(spark):
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(rnd.randint(30, 60))]
        bad = i % 5
        if bad == 0:
            words = [w + "***" for w in words]
        elif bad == 1:
            words = [w.upper() for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if bad < 2 else 1))
    labels += [(5, None), (None, 0), (99_999, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.judge_quality(docs, marks).collect()}
    assert sum(got[i].kept != (i % 5 > 1) for i in range(900)) <= 9
    assert {bool(r.rule) for r in got.values() if not r.kept} == {True} and len({r.rule for r in got.values()}) == 3
    none = quality_rules.judge_quality(docs, marks.limit(0)).where("not kept").count()
    assert none == 0 and quality_rules.judge_quality(docs.limit(0), marks).count() == 0


def test_rule_text_and_expression(spark):
    rule = quality_rules.Rule((quality_rules.Condition("a", True, 2.0), quality_rules.Condition("b", False, 1.0)))
    rows = spark.createDataFrame([(2.0, 0.5), (2.0, 1.0), (1.0, 0.0)], "a double, b double")
    assert [r[0] for r in rows.select(quality_rules.verdict([rule])).collect()] == [False, True, True]
    assert [r[0] for r in rows.select(F.coalesce(quality_rules.rule_name([rule]), F.lit(""))).collect()] == ["a >= 2 and b < 1", "", ""]
