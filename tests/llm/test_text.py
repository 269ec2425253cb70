"""Archives, main text, licences, quality rules, toxicity, and the pipeline."""

import base64
import gzip
import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from pelagos.llm import licenses, toxicity
from pelagos.llm.mixing import mixed
from pelagos.llm.simhash import shingles
from pelagos.llm.html_text import Block, _decided, _neighbour, extracted, main_text
from pelagos.llm.quality_rules import STATS, drop_rejected, judged, learn, learned_rules, text_stats
from pelagos.llm.warc import archived, read_archives, record, records, row
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_members_are_valid_gzip_of_one_record_each():
    made = [record("urn:page:5", "http://x/ y", b"hello" * 1000, "1970-01-01T00:00:00Z"), record("urn:page:6", None, bytes(17 << 20), "1970-01-01T00:00:00Z"), record("urn:page:7", "u", b"", "1970-01-01T00:00:00Z", "urn:page:5")]
    archive = b"".join(row(r) + b"\0" for r in made)
    assert gzip.decompress(archive) == b"".join(made)
    assert [h["warc-record-id"] for h, _ in records(archive)] == ["<urn:page:5>", "<urn:page:6>", "<urn:page:7>"]
    for broken in (archive[:-3], archive[:40] + b"x" + archive[41:], gzip.compress(made[0].replace(b"hello", b"hullo")), gzip.compress(made[0][:-2]), gzip.compress(b"no record")):
        with pytest.raises((ValueError, zlib.error)):
            list(records(broken))


def test_pages_come_back_from_archives(spark):
    pages = [(i, f"http://h/{i}\n" if i % 3 else None, h) for i, h in enumerate([None, "", "<p>a", "é" * 5000, "<p>a", "<p>a", "", "x" * 200_000, "é" * 5000])] + [(20, "u", "<p>a"), (None, "n", "<p>a"), (None, "n", "alone")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    wanted = set()
    for i, _, h in pages:
        data = (h or "").encode()
        to = first.get(h or "")
        again = to is not None and to != i
        wanted.add((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", to if again else None, None if again else data))
    found = archived(df).collect()
    assert {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in found} == wanted
    assert len(found) == len(pages)
    large = archived(df, least=100).collect()
    assert sum(r["record_type"] == "revisit" for r in large) == 1
    assert archived(df.limit(0)).count() == 0


def test_archives_of_others(spark, tmp_path):
    def made(lines, block):
        return gzip.compress("\r\n".join(["WARC/1.0", *lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    body = b"<p>chunk"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\n<p>\r\n5;x=y\r\nchunk\r\n0\r\n\r\n"
    plain = b"HTTP/1.0 200 OK\r\n\r\nhello"
    sha = hashlib.sha1(b"hello").hexdigest()
    archive = b"".join(
        [
            made(["WARC-Type: warcinfo", "Content-Type: application/warc-fields"], b"software: x\r\n"),
            made(["WARC-Type: response", "WARC-Record-ID: <urn:a>", "WARC-Target-URI: http://a/"], chunked),
            made(["WARC-Type: response", "WARC-Record-ID: <urn:b>", f"WARC-Payload-Digest: sha1:{sha}", "WARC-Block-Digest: md5:abc"], plain),
            made(["WARC-Type: response", "WARC-Record-ID: <urn:c>", "Content-Type: text/dns"], b"a record"),
            made(["WARC-Type: revisit", "WARC-Record-ID: <urn:d>", "WARC-Refers-To: <urn:b>"], b"HTTP/1.1 304 Not Modified\r\n\r\n"),
            made(["WARC-Type: request"], b"GET / HTTP/1.1\r\n\r\n"),
        ]
    )
    (tmp_path / "a.warc.gz").write_bytes(archive)
    found = {r["record_id"]: r for r in read_archives(spark, f"file://{tmp_path}").collect()}
    assert set(found) == {"urn:a", "urn:b", "urn:c", "urn:d"}
    for name, data in (("urn:a", body), ("urn:b", b"hello"), ("urn:c", b"a record")):
        assert (bytes(found[name]["payload"]), found[name]["payload_bytes"], found[name]["payload_digest"]) == (data, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    assert tuple(found["urn:d"])[2:] == ("revisit", None, None, "urn:b", None)
    (tmp_path / "b.warc.gz").write_bytes(made(["WARC-Type: response", f"WARC-Payload-Digest: sha1:{sha}"], plain.replace(b"hello", b"hallo")))
    with pytest.raises(Exception, match="wrong payload digest"):
        read_archives(spark, f"file://{tmp_path}").collect()


PAGE = """<html><body class="has-sidebar"><div id="cookie-notice">We use cookies on the site to be nice and it is good for you and for us in all of the ways that matter to the law of the land.</div>
<header><h1>Site</h1><ul class=menu><li><a href=/>Home</a></ul></header><div class="content"><h2>Title &amp; more</h2>
<p>This is the first paragraph of the article and it is long enough to be decided by the length of the text and by the words that are in it, is it not.<p>Short&nbsp;one,
 in two lines.</p><div class="ad-box">Buy the best of the things that you can buy in the shop</div><p>Last &lt;b&gt; x<br>y</p><form><label>Name</label><button>Send</button></form></div>
<aside>Related <a href=x>link</a></aside><section class="comments"><article class="comment"><p>I like the article and I think that it is the best of all of the articles that were on the site of the people that write the articles.</p></article></section>
<script>var a = "<p>no</p>";</script><style>p{}</style><footer>(c) me</footer></body></html>"""


def test_main_text_of_a_page():
    assert main_text(PAGE).split("\n") == [
        "Title & more",
        "This is the first paragraph of the article and it is long enough to be decided by the length of the text and by the words that are in it, is it not.",
        "Short one, in two lines.",
        "Last <b> x y",
    ]
    for html, text in (("", ""), ("<", "<"), ("plain text", "plain text"), ("<p", ""), ("<script>x", ""), ('<p title="x>y">q</p>', "q"), ("<nav>a</nav>", ""), ("<article><p>a</article><p>b", "a")):
        assert main_text(html) == text


def test_main_text_by_names_and_neighbours():
    long = "It is the text of a paragraph that is long and that has the words which are in all of the texts, so that it is decided by itself and by nothing else. "
    page = f"<body><ul><li class='comment'>bad one<li>ok item</ul><h3 class='related'>More</h3><h2>Head</h2><p>{long}<p>short<div id=sidebar><p>{long}</div><p>{long}</p><div><a href=a>one</a> <a href=b>two</a></div><p>last</body>"
    assert main_text(page).split("\n") == ["ok item", "Head", long.strip(), "short", long.strip()]
    assert main_text("<div><p>" + "a b c " * 100 + "</p></div>") == ("a b c " * 100).strip()  # no stop words, nothing else near


def test_elements_that_are_left_out_end_where_they_end():
    for tag in ('<svg-icon name="x"></svg-icon>', '<svg class="i"/>', "<math/>", "<video-player>", "<template-x></template-x>", "<script-loader>", "<svg>", "<video src=a>", "<svg><text>no</text></svg>", "<script>no</script>"):
        assert main_text(f"<article><p>One.</p>{tag}<p>Two.</p></article>") == "One.\nTwo.", tag
    assert main_text("<p>a" + "<video>" * 50_000 + "b") == "ab"


def test_articles_in_wrappers_with_telling_names_stay():
    long = "It is the text of a paragraph that is long and that has the words which are in all of the texts, so that it is decided by itself and by nothing else."
    for wrapper in ('div class="layout has-sidebar"', 'div class="page-with-sidebar"', 'div id="no-nav"', 'div class="hasSidebar"', "form method=post", "form role=form"):
        assert main_text(f"<body><{wrapper}><div><p>{long}</p></div></{wrapper.split()[0]}>") == long, wrapper
    for begin in ("<article>", "<main>", "<div role=main>", "<div itemprop=articleBody>"):
        assert main_text(f"<div class='sidebar-layout'>{begin}<p>{long}</p></div>") == long, begin
    for names in ("related-work", "social-impact", "login-flow", "navigation"):
        assert main_text(f"<article><h2 id={names}>Head</h2><p>{long}</p><section id={names}><p>{long}</p></section></article>") == f"Head\n{long}\n{long}"
    for apart in (f"<form><p>{long}</p></form>", f"<aside><article><p>{long}</p></article></aside>", f"<div class=related><article><p>{long}</p></article></div>", f"<div hidden><main><p>{long}</p></main></div>", f"<div class=sidebar><p>{long}</p></div>"):
        assert main_text(f"<div><p>{long}</p></div>{apart}") == long, apart


def slow_neighbour(page, first, i):
    """The second pass as it is defined: from an open block outwards."""
    b = page[i]

    def side(step):
        j, far = i + step, 0
        while 0 <= j < len(page) and page[j].main == b.main:
            if first[j] is not None and not page[j].apart:
                return far, first[j]
            far += page[j].chars
            j += step
        return None

    before, after = side(-1), side(1)
    if b.heading and after:
        return after[1]
    if before and after:
        return before[1] if before[0] < after[0] else after[1] if after[0] < before[0] else before[1] or after[1]
    return before[1] if before else after[1] if after else None


def test_second_pass_agrees_with_looking_outwards():
    rng = random.Random(8)
    for _ in range(300):
        page = [Block("x" * rng.choice((1, 1, 5, 9)), 0, rng.random() < 0.1, rng.choice((0, 0, 0, 1)), rng.random() < 0.2, 0) for _ in range(rng.randint(0, 25))]
        first = [rng.choice((None, None, True, False)) for _ in page]
        before, after = list(_decided(page, first)), list(_decided(page[::-1], first[::-1]))[::-1]
        assert [_neighbour(b, x, y) for b, x, y in zip(page, before, after)] == [slow_neighbour(page, first, i) for i in range(len(page))]


def test_long_pages_take_linear_time():
    for unit in ("<p>short", "<!", "<div>", "<li><a href=x>y</a>", "<p>a</span>"):
        began = time.perf_counter()
        main_text(unit * 100_000)
        assert time.perf_counter() - began < 10, unit
    began = time.perf_counter()
    main_text("<div>" * 50_000 + "</p>" * 50_000)
    assert time.perf_counter() - began < 5


def test_more_wrappers_keep_their_article():
    long = "It is the text of a paragraph that is long and that has the words which are in all of the texts, so that it is decided by itself and by nothing else."
    for names in ("layout has-sidebar", "content with-comments", "page no-sidebar", "post-share-enabled", "main-content cookie-consent-ok", "single-post related-on"):
        assert main_text(f"<body><div class='{names}'><article><p>{long}</p></article></div></body>") == long, names


def test_clashing_names_of_kept_columns(spark):
    df = spark.createDataFrame([(1, "<p>a", "b", 3)], "page_id long, html string, `_html` string, text int")
    assert [tuple(r) for r in extracted(df, keep=("page_id", "_html")).collect()] == [(1, "b", "a", 1)]
    with pytest.raises(ValueError):
        extracted(df, keep=("text",))


def test_extraction_of_whole_tables(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, None, None), (None, "v", "<p>é</p>")], "page_id long, url string, html string")
    found = extracted(df).collect()
    assert Counter((r["page_id"], r["text"], r["n_chars"]) for r in found) == Counter({(1, main_text(PAGE), len(main_text(PAGE))): 1, (2, "", 0): 2, (None, "é", 1): 1})
    assert extracted(df.limit(0)).count() == 0


def test_licences_and_notices(spark):
    mit = licenses.TEXTS[0][1]
    changed = "Copyright (c) 2024 Someone\nAll rights reserved.\n\n" + mit.replace("sublicense", "sub-license").replace(" ", "  ").upper().replace("LICENSE", "LICENCE")
    rows = [(1, mit), (2, changed), (3, mit + " and more"), (4, "some text\nLicensed under the Apache Licence, version 2.0\nReleased under the MIT license!\nother"), (5, None), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter((r["doc_id"], r["license_id"], r["notice_ids"]) for r in licenses.scanned(df).collect())
    assert found == Counter({(1, "MIT", ""): 1, (2, "MIT", ""): 1, (3, None, ""): 1, (4, None, "Apache-2.0,MIT"): 1, (5, None, ""): 2, (6, None, ""): 1})
    assert licenses.scanned(df.limit(0)).count() == 0


def test_wrapped_licences_with_other_list_marks(spark):
    import textwrap

    rows, wanted = [], {}
    for name, text in licenses.TEXTS:
        if name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "BSL-1.0"):
            for width in range(20, 90):
                body = "\n\n".join(textwrap.fill(p, width, break_long_words=False) for p in text.split("\n\n"))
                for mark in ("{}. ", "* ", "- ", "({}) "):
                    marked = re.sub(r"(?m)^(?:\* |[123]\. )", lambda m, n=iter("123"): mark.format(next(n)), body) if "BSD" in name else body
                    wanted[len(rows)] = name
                    rows.append((len(rows), "Copyright (c) 2024, Someone\nCopyright 2023 Other\nAll rights reserved.\n\n" + marked))
                    if "BSD" not in name:
                        break
    found = {r["doc_id"]: r["license_id"] for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == wanted


def test_long_licences_by_digests(spark):
    import pathlib
    import textwrap

    folder = pathlib.Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "GFDL-1.3": "GFDL-1.3-only"}
    files = {folder / f: name for f, name in files.items() if (folder / f).exists()}
    if not files:
        pytest.skip("no licence texts on this machine")
    rows, wanted = [], []
    for path, name in files.items():
        text = path.read_text()
        end = text.find("END OF TERMS AND CONDITIONS")
        same = [text, text.upper().replace("LICENSE", "LICENCE"), textwrap.indent(text, "   "), "Copyright 2024 Someone\n\n" + text, text.replace("\n", "\r\n"), *[text[: end + 27]] * (end > 0)]
        for t, who in [*((t, name) for t in same), (text + "\nand more", None), (text[: len(text) // 2], None)]:
            wanted.append(who)
            rows.append((len(rows), t))
    found = {r["doc_id"]: r["license_id"] for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[i] for i in range(len(rows))] == wanted
    assert licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string"), digests=[], texts=licenses.TEXTS[:1]).where("license_id is not null").count() == 0


def slow_stats(text):
    w = WORD.findall(text)
    seen, lines = set(), 0
    for x in text.split("\n"):
        if WORD.search(x):
            lines += x in seen
            seen.add(x)
    windows = list(zip(w, w[1:], w[2:]))
    count, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered)


def test_stats_agree_with_the_definition():
    rng = random.Random(4)
    texts = [t or "" for t in cases.texts()] + [" ".join(rng.choice("ab") for _ in range(n)) for n in range(12)]
    for text in texts:
        assert text_stats(text.encode()) == slow_stats(text)


def labelled(rng, n=1500):
    stats, good = [], []
    for _ in range(n):
        words = rng.randint(50, 900)
        bad = rng.random() < 0.2
        stats.append((words, words * 5, words if bad and rng.random() < 0.5 else 0, 0, int(words * 0.4) if bad else 0))
        good.append(not bad)
    return np.array(stats), np.array(good)


def test_rules_separate_what_can_be_separated():
    stats, good = labelled(random.Random(1))
    part = np.arange(len(good)) % 3 != 0
    rules = learn(stats, good, part)
    order = np.random.default_rng(5).permutation(len(good))
    assert learn(stats[order], good[order], part[order]) == rules
    assert 1 <= len(rules.rules) <= 3
    assert "drop" in str(rules)
    assert learn(stats[:0], good[:0], part[:0]).rules == []
    assert learn(stats, np.ones(len(good), bool), part).rules == []
    assert learn(stats, np.random.default_rng(0).random(len(good)) < 0.8, part).rules == []  # noise has no rule


def test_quality_of_whole_tables(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        w = [f"w{rng.randrange(5000)}" + ("###" if i % 5 == 0 else "") for _ in range(rng.randint(20, 120))]
        rows.append((i, " ".join(w)))
    rows += [(700, None), (701, ""), (None, "x"), rows[1]]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, `_text` int, n_words int")
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(400)] + [(5, None), (None, 1)], "doc_id long, quality int")
    rules = learned_rules(docs, labels)
    found = {r["doc_id"]: r for r in judged(docs, rules).collect()}
    for i, text in rows:
        assert tuple(found[i][s] for s in STATS) == slow_stats(text or "")
        assert found[i]["base_failed"] == (len(WORD.findall(text or "")) < 50)
        assert found[i]["kept"] == (not found[i]["base_failed"] and i % 5 != 0)
    kept = drop_rejected(docs, rules)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.collect()) == sorted(i for i, _ in rows if found[i]["kept"])
    assert judged(docs.limit(0), rules).count() == 0
    assert learned_rules(docs, labels.limit(0)).rules == []


def slow_verdict(rules, stats):
    """The list read rule by rule, one row at a time."""
    words, chars, symbols, lines, repeated = stats
    value = {"words": words, "chars_per_word": chars / max(words, 1), "symbols_per_char": symbols / max(chars, 1), "duplicate_lines_per_word": lines / max(words, 1), "repeated_share": repeated / max(words, 1)}
    if words < 50 or 100 * repeated > 50 * words:
        return False
    for rule in rules.rules:
        if all((value[c.feature] >= c.threshold) == c.above for c in rule):
            return not rules.default
    return rules.default


def test_rules_and_verdicts_do_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(3)
    texts = {}
    for i in range(900):
        bad = i % 4 == 0 and rng.random() < 0.9
        texts[i] = " ".join(f"w{rng.randrange(5000)}" + ("#" * rng.randint(1, 3) if bad or rng.random() < 0.05 else "") for _ in range(rng.randint(45, 150)))
    rows = list(texts.items()) + [(7, texts[7])] * 300 + [(7, " ".join(f"x{k}" for k in range(60)))] + [(5000, None), (None, texts[1])]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(700)] + [(9, 0), (10, None)], "doc_id long, quality int")
    found = []
    for seed, parts in ((1, 1), (2, 3), (3, 8)):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        found.append(learned_rules(docs, labels.repartition(parts)))
    assert found[0] == found[1] == found[2] and found[0].rules
    for r in judged(docs, found[0]).collect():
        assert r["kept"] == slow_verdict(found[0], [r[s] for s in STATS])


def test_rules_hold_few_texts_outside_the_heap(spark):
    arrow = spark._jvm.org.apache.spark.sql.util.ArrowUtils.rootAllocator()
    docs = spark.range(1200, numPartitions=1).selectExpr("id as doc_id", "array_join(transform(sequence(1, 2000), x -> x * 1201 + id), ' ') as text")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    before = arrow.getPeakMemoryAllocation()
    kept = drop_rejected(docs, learned_rules(docs, labels))
    assert kept.agg({"doc_id": "sum"}).first()[0] == 1200 * 1199 // 2
    assert judged(docs, learned_rules(docs, labels)).where("kept and n_words = 2000").count() == 1200
    # 10 MB of texts: no more than a few of them at a time
    assert arrow.getPeakMemoryAllocation() <= max(before, 4 << 20)


def test_nearest_examples_agree_with_all_cosines():
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(1500):
        t = np.sort(rng.choice(60, rng.integers(1, 8), replace=False))
        w = rng.random(len(t)) + 0.1
        rows.append((t, w / np.sqrt(w @ w)))
    index = toxicity.BlockMaxIndex(rows, rng.integers(0, 2, 1500), 60)
    dense = np.zeros((1500, 60))
    for i, (t, w) in enumerate(rows):
        dense[i, t] = w
    for i in range(0, 1500, 7):
        scores = dense @ dense[i]
        for without in (-1, i):
            s = scores.copy()
            if without >= 0:
                s[without] = 0
            best = sorted((-x for x in s if x > 0))[:15]
            e, found = index.nearest(*rows[i], 15, without)
            assert np.allclose(found, [-x for x in best])
            assert np.allclose(found, s[e])


def slow_scores(rows, labels):
    """Scores and evidence cosines by dense vectors over all words, without an index."""
    words = {i: toxicity.terms((t or "").encode()) for i, t in rows}
    learned = sorted((i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1)
    vocabulary = sorted({w for i, _ in learned for w in words[i]})
    at = {w: k for k, w in enumerate(vocabulary)}
    df, a, b = (np.zeros(len(at)) for _ in range(3))
    for _, t in rows:
        for w in set(toxicity.terms((t or "").encode())) & at.keys():
            df[at[w]] += 1
    for i, y in learned:
        for w in set(words[i]):
            (a if y else b)[at[w]] += 1
    n1 = sum(y for _, y in learned)
    n0, n = len(learned) - n1, len(learned)
    chi = n * (a * (n0 - b) - b * (n1 - a)) ** 2 / (n1 * n0 * (a + b) * np.maximum(n - a - b, 1))
    factor = np.log((1 + len(rows)) / (1 + df)) * (0.3 + np.where(a * n0 > b * n1, np.sqrt(chi), 0))

    def vector(t):
        v = np.zeros(len(at))
        for w, k in Counter(x for x in t if x in at).items():
            v[at[w]] = (1 + np.log(k)) * factor[at[w]]
        return v / (np.sqrt(v @ v) or 1)

    own, y = np.array([vector(words[i]) for i, _ in learned]), np.array([y for _, y in learned])
    prior = n1 / n

    def vote(scores):
        top = np.argsort(-scores, kind="stable")[:15]
        s = np.maximum(scores[top], 0)
        return (s @ y[top] + 0.1 * prior) / (s.sum() + 0.1), s

    loo = own @ own.T
    np.fill_diagonal(loo, 0)
    steps = toxicity.isotonic(np.array([vote(r)[0] for r in loo]), y.astype(float))
    out = {}
    for i, t in rows:
        v = vector(words[i])
        raw, s = vote(own @ v)
        out[i] = (0.9 * np.interp(raw, *steps) + 0.1 * raw, s[s > 0]) if v.any() else (prior / 1, s[:0])
    return out


def test_isotonic_fit_rises_and_keeps_the_mean():
    rng = np.random.default_rng(1)
    x = rng.random(300).round(2)
    y = (rng.random(300) < x).astype(float)
    a, b = toxicity.isotonic(x, y)
    assert (np.diff(a) > 0).all() and (np.diff(b) >= 0).all() and 0 <= b.min() <= b.max() <= 1


def toxic_rows():
    rng = random.Random(7)
    bad = ["loser", "moron", "scum", "clown"]
    rows, labels = [], []
    for i in range(900):
        w = [f"w{rng.randrange(800)}" for _ in range(rng.randint(5, 80))]
        if toxic := i % 6 == 0:
            for b in rng.sample(bad, 3):
                w.insert(rng.randrange(len(w)), b.upper() + "!")
        rows.append((i, " ".join(w)))
        if i % 3 != 1:
            labels.append((i, int(toxic)))
    return rows, labels


def test_toxic_texts_are_found_in_held_out_rows(spark):
    rows, labels = toxic_rows()
    rows += [(2000, None), (2001, ""), (None, "x"), rows[6]]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, `_text` int, score int")
    labels = spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id long, toxic int")
    found = toxicity.scored(docs.repartition(3), labels).collect()
    assert len(found) == len(rows)
    right = 0
    for r in found:
        i = r["doc_id"]
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1)
        right += (r["score"] >= 0.7) == (i is not None and i < 900 and i % 6 == 0)
        if r["score"] >= 0.7:
            assert r["evidence"][0]["label"] == 1
            assert [e["cosine"] for e in r["evidence"]] == sorted((e["cosine"] for e in r["evidence"]), reverse=True)
    assert right >= 0.99 * len(found)
    assert toxicity.scored(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity.scored(docs, labels.limit(0)).collect()} == {0.5}


def test_scores_agree_with_dense_cosines(spark):
    rows, labels = toxic_rows()
    wanted = slow_scores(rows, labels)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(labels, "doc_id long, toxic int")
    for r in toxicity.scored(docs, marks).collect():
        score, cosines = wanted[r["doc_id"]]
        assert np.allclose([e["cosine"] for e in r["evidence"]], cosines)
        assert abs(r["score"] - score) < 1e-6


def test_scores_of_tables_with_all_that_tables_have(spark):
    docs = cases.table(spark)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 150, 2)] + [(4, 1), (30, 0)], "doc_id long, toxic int")
    found = toxicity.scored(docs, labels).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in cases.rows())
    assert all(0 <= r["score"] <= 1 for r in found)
    again = toxicity.scored(docs.repartition(2), labels.repartition(3)).collect()
    assert sorted((r["doc_id"] or -1, round(r["score"], 9)) for r in found) == sorted((r["doc_id"] or -1, round(r["score"], 9)) for r in again)


def test_pipeline_agrees_with_its_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(9)
    rows = []
    for i in range(300):
        w = [f"w{rng.randrange(3000)}" + ("%%%" if i % 7 == 0 else "") for _ in range(rng.randint(40, 160))]
        rows.append((i, " ".join(w), "en", f"s{i % 4}", 0))
    rows += [(400 + i, rows[i][1].replace(" ", " \n ", 1), "en", "s1", 0) for i in range(20)]  # copies but for white space
    rows += [(500 + i, rows[i][1].replace("w1", "x1", 1), "en", "s2", 0) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    sizes = []
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{len(sizes)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(sizes)}")
        sizes.append(docs)
    good = {r[0] for r in rows if len(r[1].split()) >= 50 and "%%%" not in r[1]}
    assert {r[0] for r in sizes[0].select("doc_id").collect()} == good
    exact = {r[0] for r in sizes[1].select("doc_id").collect()}
    first = {}
    for r in sorted(rows):
        if r[0] in good:
            first.setdefault(r[1].replace(" \n ", " "), r[0])
    assert exact == set(first.values())
    near = {r[0] for r in sizes[2].select("doc_id").collect()}
    text = {r[0]: shingles(r[1].encode()) for r in rows}
    similar = {(x, y) for x in exact for y in exact if x < y and len(text[x] & text[y]) >= 0.8 * len(text[x] | text[y])}
    assert near == exact - {y for _, y in similar}  # groups are of two here
    assert similar
    taken = {r["doc_id"]: r["copies"] for r in mixed(sizes[2]).collect()}
    assert Counter(r[0] for r in sizes[3].select("doc_id").collect()) == +Counter(taken)
    packing = sizes[4].collect()
    at = Counter()
    for r in sorted(packing, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= 4096
    pieces = Counter(r[0] for r in sizes[4].where("piece = 0").select("doc_id").collect())
    assert pieces == Counter(r[0] for r in sizes[3].select("doc_id").collect())
    assert sorted(map(tuple, cp.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect())) == sorted(map(tuple, sizes[4].drop("sequence_id", "offset").collect()))
