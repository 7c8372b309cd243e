"""Operators 2, 4 and 6, and the pipeline, against brute force, held-out accuracy and planted cases."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import html_text, language_id, sanitise

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# Personal data


def brute_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(5)
    parts = ["a.b%c", "@", "x-1.org", ".", "..", "+", "1", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1111-", " ", "(", ")", "-", "é", "+1 (555) 010-9999", "10.0.0.1", "_", "\n", "user@host.example.com", "@@", "٣"]
    for _ in range(4000):
        text = "".join(rng.choice(parts, int(rng.integers(1, 12))))
        assert sanitise.base_spans(text) == brute_base(text), text


def test_many_spans_are_fast():
    text = "mail me@here.org now or " * 20_000
    assert len(list(sanitise.words(text, sanitise._edges(sanitise.base_spans(text))))) == 60_000


def test_base_spans_of_long_runs_are_fast():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 100_000, "@" * 100_000, "+" * 100_000, "+1 " * 50_000, ("a" * 1000 + "@.") * 100):
        sanitise.base_spans(text)


def brute_words(text):
    spans = brute_base(text)
    at = [m.span() for m in re.finditer(r"[^\W\d_]+", text)]
    return [(text[a:b].lower(), a, b) for a, b in at if b - a > 1 and not any(a < y and x < b for _, x, y in spans)]


def test_words_lie_outside_spans():
    rng = np.random.default_rng(10)
    parts = ["word", "a@b.org", "x", " ", ".", "10.0.0.1", "next-to", "+1 555 010 99999", "über", "9"]
    for _ in range(1500):
        text = "".join(rng.choice(parts, int(rng.integers(1, 25))))
        assert list(sanitise.words(text, sanitise._edges(sanitise.base_spans(text)))) == brute_words(text)


@pytest.fixture(scope="module")
def private(spark):
    texts = {i: f"common words here {i} stand about nothing much and more" for i in range(40)}
    for i in (1, 2, 3, 4):
        texts[i] = "common words zorbl write to bo.b@x.example.org or " + "so it goes on " * 200 + f"quendle about nothing {'abcd'[i - 1] * 3}"
    texts[5] = "common Zorbl alone"
    texts |= {6: None, 7: "", 8: "bo.b@x.example.org", 9: "call +1 (555) 010-9999 now"}
    rows = [(i, t, None, None, None) for i, t in texts.items()] + [(9, texts[9], None, None, None), (5, "plain text of one id", None, None, None), (None, texts[5], None, None, None)]
    return spark.createDataFrame(rows, DOCS).withColumns({"row": F.lit(1), "entity": F.lit("x"), "terms": F.lit(2), "text_key": F.lit(3)}), rows


def brute_terms(texts, threshold, support):
    """Disclosing terms by counting documents, with what becomes of them."""
    docs = [x or "" for x in texts]
    holds = [{sanitise._entity(k, x[a:b]) for k, a, b in brute_base(x)} for x in docs]
    has = [{w for w, *_ in brute_words(x)} for x in docs]
    out = {}
    for entity in set().union(*holds):
        mine = [h for h, held in zip(has, holds) if entity in held]
        def disclosure(match):
            both, t = sum(any(map(match, h)) for h in mine), sum(any(map(match, h)) for h in has)
            return np.log(len(docs) * both / (len(mine) * t)) / np.log(len(docs) / len(mine)), both

        for term in set().union(*mine):
            d, both = disclosure(lambda w, term=term: w == term)
            if both >= support and d >= threshold:
                wide, _ = disclosure(lambda w, term=term: w[:3] == term[:3])
                out[term] = max(out.get(term, ""), "generalise" if wide < threshold else "remove")
    return out


@pytest.mark.parametrize("threshold, most", [(0.85, 1_000_000), (0.6, 1_000_000), (0.6, 0)])
def test_disclosing_terms(private, threshold, most):
    docs, rows = private
    scanned = sanitise.materialise(sanitise.scan(docs))
    joint = sanitise.joint_terms(scanned, threshold, 3)
    terms = sanitise.materialise(joint.where("not term like '%*'").select("term").distinct())
    found = sanitise.disclosing_terms(scanned, joint, sanitise.materialise(sanitise.occurrences(docs, terms, most)), threshold).collect()
    got = {}
    for r in found:
        got[r["term"]] = max(got.get(r["term"], ""), r["action"])
    assert got == brute_terms([r[1] for r in rows], threshold, 3)
    assert "quendle" in got and "common" not in got


def test_planted_terms_are_caught(spark):
    """Terms that go with an entity, far from it and in some documents without it, are flagged wherever they stand, others are not."""
    rng = np.random.default_rng(11)
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu") for b in ("re", "so", "ta", "vi") for c in ("x", "yz", "qua", "den", "for")]
    aliases, texts = [f"alias{chr(97 + k)}bert" for k in range(20)], []
    for k, alias in enumerate(aliases):
        for i in range(6):
            texts.append(" ".join([f"user{k}@mail.example.org", *rng.choice(vocabulary, 60), alias if i < 5 else "", *rng.choice(vocabulary, 10)]))
        texts.append(" ".join([*rng.choice(vocabulary, 30), alias]))
    texts += [" ".join(rng.choice(vocabulary, 60)) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = sanitise.find_private(docs).collect()
    flagged = {r["doc_id"]: {texts[r["doc_id"]][t["start"] : t["end"]] for t in r["terms"]} for r in got}
    planted = {i: {a for a in aliases if a in t.split()} for i, t in enumerate(texts)}
    caught = sum(len(flagged[i] & planted[i]) for i in planted)
    assert caught >= 0.9 * sum(map(len, planted.values())) and not any(flagged[i] - planted[i] for i in planted)


def test_copies_are_no_evidence(spark):
    """Repeated rows, copies and mails of one wording count once; the same term in texts of other words is still found, in its copies as well."""
    rng = np.random.default_rng(5)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "so") for b in ("re", "sot", "tam", "vil", "xen")]
    mail, copied = "dunno@x.example.org said hello to grumbold", "cat@y.example.org went and fetched mirabel"
    texts = [copied] * 5 + [f"{mail} at {i} o'clock" for i in range(5)]
    for i in range(4):
        texts += [" ".join(["dog@z.example.org", *rng.choice(vocabulary, 8), "zebulon"])] * 3
    texts += [" ".join(rng.choice(vocabulary, 20)) for _ in range(60)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, copied, None, None, None), rows[11], rows[11]]
    got = sanitise.find_private(spark.createDataFrame(rows, DOCS), 0.8).collect()
    flagged = sorted((str(r["doc_id"]), texts[r["doc_id"]][t["start"] : t["end"]]) for r in got for t in r["terms"])
    assert flagged == sorted((str(r[0]), "zebulon") for r in rows if "zebulon" in r[1])


def test_shares_of_repeated_texts_sum_up_to_documents(spark):
    texts = [(1, "a@b.example.org one two"), (1, "a@b.example.org one two"), (1, "a@b.example.org one two"), (2, "a@b.example.org one two"), (3, "a@b.example.org 7 two one"), (4, "onyx"), (None, "onyx"), (None, None), (None, None), (5, "")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in texts], DOCS)
    terms = spark.createDataFrame([("one",), ("two",)], "term string")
    repeated = sanitise.repeated_texts(sanitise.materialise(sanitise.scan(docs)))
    for most in (10, 0):
        counts = sanitise.occurrences(docs, terms, most, repeated).groupBy("term").agg(F.round(F.sum("n")).alias("n"))
        assert {r["term"]: r["n"] for r in counts.collect()} == {"one": 1, "two": 1, "one*": 1, "two*": 1}


def test_sanitised_texts(private):
    docs, rows = private
    got = [(r["doc_id"], r["text"]) for r in sanitise.sanitise(docs, threshold=0.8).collect()]
    by_id = dict(got)
    assert len(got) == len(rows) and by_id[6] is None and by_id[7] == ""
    assert by_id[8] == "[email]" and by_id[9] == "call [phone] now"
    # Zorbl is taken out of the document without the entity as well, whatever else carries its doc_id.
    assert sorted(t for i, t in got if i == 5) == ["common  alone", "plain text of one id"] and by_id[None] == "common  alone"
    assert not any(w in by_id[1] for w in ("bo.b", "quendle", "zorbl")) and by_id[1].startswith("common words")


def test_private_query_columns(private):
    docs, rows = private
    found = sanitise.find_private(docs).collect()
    got = sorted(((r["doc_id"], [(m["kind"], m["start"], m["end"]) for m in r["mentions"]]) for r in found), key=repr)
    assert got == sorted(((i, brute_base(t or "")) for i, t, *_ in rows), key=repr)


def test_nothing_private(spark):
    empty = spark.createDataFrame([], DOCS)
    assert sanitise.find_private(empty).count() == 0 and sanitise.sanitise(empty).count() == 0


# Languages


@pytest.fixture(scope="module")
def tongues(spark):
    rng = np.random.default_rng(6)
    parts = {"aa": ["the", "ing", "and", "wh", "tion"], "bb": ["sch", "ein", "ung", "über", "keit"], "cc": ["eau", "oui", "çe", "ille", "ment"]}
    rows = [(i, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(int(rng.integers(3, 60)))), lang, "s", 0) for i, lang in enumerate(rng.choice(list(parts), 240))]
    return spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(1))


def test_languages_of_held_out_documents(spark, tongues):
    network = language_id.train(tongues, per_label=60, epochs=10)
    odd = spark.createDataFrame([(1000, None, "aa", None, None), (1001, "", None, None, None), (1002, "12 34!", None, None, None), (None, "the and the", None, None, None), (1003, "sch" * 50_000, None, None, None)], DOCS)
    got = {r["doc_id"]: r for r in language_id.identify(tongues.drop("score").unionByName(odd), network).collect()}
    truth = {r["doc_id"]: r["lang"] for r in tongues.collect()}
    assert {i for i in truth if got[i]["held_out"]} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    held = [i for i in truth if got[i]["held_out"]]
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003]["lang_pred"] == "bb" and not got[None]["held_out"]


def test_training_reads_no_held_out_document(spark, tongues):
    wrong = tongues.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    labels, symbols, truth = language_id.training_windows(wrong, 50, 64, 4)
    assert labels == ["aa", "bb", "cc"] and set(truth) == {0, 1, 2}


def test_gradients_match_differences():
    rng = np.random.default_rng(7)
    net = language_id.BiGRU(["a", "b", "c"], hidden=4)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    symbols, truth = rng.integers(97, 103, (7, 5)).astype(np.int16), rng.integers(0, 3, 5)
    symbols[5:, 0] = language_id.PAD

    def loss():
        real = symbols != language_id.PAD
        return -(net.position_log_probs(symbols)[:, np.arange(5), truth] * real).sum() / real.sum()

    grads = net.train_step(symbols, truth)
    for key in net.w:
        flat = net.w[key].reshape(-1)
        for at in rng.integers(0, flat.size, 6) if key[0] != "x" else [98 * 12 + 1, 99 * 12 + 5, 100 * 12 + 10]:
            was, step = flat[at], 1e-2
            flat[at] = was + step
            up = loss()
            flat[at] = was - step
            down = loss()
            flat[at] = was
            assert abs((up - down) / (2 * step) - grads[key].reshape(-1)[at]) < 2e-3


def test_prediction_by_brute_force():
    """Each byte by its own formulas in windows of 5, forwards and backwards, and the geometric mean over all bytes."""
    net = language_id.BiGRU(["a", "b", "c"], hidden=3, seed=4)
    w = {k: v.astype(np.float64) for k, v in net.w.items()}
    sigma = lambda x: 1 / (1 + np.exp(-x))

    def states(data, d):
        h, out = np.zeros(3), []
        for byte in data if d == "f" else data[::-1]:
            a, b = w["x" + d][byte], h @ w["u" + d]
            z, r = sigma(a[:3] + b[:3]), sigma(a[3:6] + b[3:6])
            h = h + z * (np.tanh(a[6:] + r * b[6:]) - h)
            out.append(h)
        return out if d == "f" else out[::-1]

    def brute(text):
        total = np.zeros(3)
        for at in range(0, len(text), 5):
            window = [*text[at : at + 5]] + [language_id.PAD] * max(0, at + 5 - len(text))
            for k, (f, b) in enumerate(zip(states(window, "f"), states(window, "b"))):
                if window[k] != language_id.PAD:
                    x = f @ w["of"] + b @ w["ob"] + w["bias"]
                    total += x - np.log(np.exp(x).sum())
        p = np.exp(total / max(1, len(text)))
        return p / p.sum()

    texts = ["ein Wörtchen und noch eins".encode(), b"a", b"", b"12345", b"abcdefghij" * 7]
    for at_once in (2, 3, 2048):
        assert net.predict(texts, 5, at_once) == pytest.approx(np.array([brute(t) for t in texts]), abs=1e-4)


def test_sample_is_bounded_and_distinct(spark):
    rows = [(i % 7, f"text number {i % 90}", ["aa", "bb"][i % 2], "s", 0) for i in range(1000)] + [(5, None, "aa", "s", 0), (None, "no id", "bb", "s", 0)]
    labels, symbols, truth = language_id.training_windows(spark.createDataFrame(rows, DOCS), 20, 64, 4)
    assert labels == ["aa", "bb"] and len(symbols) == len(truth) == 40 and np.bincount(truth).tolist() == [20, 20]
    labels, *_ = language_id.training_windows(spark.createDataFrame(rows[:999], DOCS), 20, 64, 4, most_labels=1)
    assert labels == ["aa"]


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "words", None, None, None)], DOCS)
    assert language_id.train(docs) is None
    assert language_id.identify(docs, None).first()["lang_pred"] == "und"
    assert language_id.identify(docs.limit(0), None).count() == 0


# Pages

ARTICLE = ["A heading", "First words of the text, long enough to be dense, and then some more of them.", "Second part & more, with a link in it, that goes on for a while as well."]
BODY = f"<h1>{ARTICLE[0]}</h1><p>{ARTICLE[1]}</p>\n<p>Second   part &amp; more, with <a href=x>a link</a> in it,\n that goes on for a while as well.</p>"
MENU = "<ul><li><a href=/a>Home</a></li><li><a href=/b>About us</a></li></ul>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav>{MENU}</nav><article>{BODY}</article><footer>(c) 2020</footer></body></html>",
        f"<body><div id=menu>{MENU}</div><div class='ad'>Buy now at once</div><div class=content>{BODY}</div><div class='comments'><p>Nice text, I read all of it and liked it very much indeed, thanks.</p></div></body>",
        f"<body><header><h2>Site</h2></header><main>{BODY}<form><input name=q><button>Go</button></form><aside><p>Related things to read</p></aside></main>",
        f"<div class='site-header'>{MENU}</div><section>{BODY}<div class='cookie-notice'>We use cookies</div></section><div role=complementary>Side</div>",
        f"<BODY><DIV ID='sidebar'>{MENU}</DIV><DIV>{BODY}<!-- ad --><noscript>no</noscript></DIV>",
    ],
)
def test_article_alone(page):
    assert html_text.main_text(page) == "\n".join(ARTICLE)


def test_lists_of_links_in_the_article_stay():
    prose = ["<p>" + " ".join(f"{w}{i}" for i in range(60)) + ".</p>" for w in ("some", "more")]
    names = "<ul><li><a href=/a>First linked name</a></li><li><a href=/b>Second linked name</a></li></ul>"
    around = "<div><a href=/x>Site links here</a> <a href=/y>and more there</a></div>"
    wrapped = "<div><p>See <a href=/c>a long linked title of a source</a>.</p></div>"
    menu = "<h1>Title</h1>" + around
    whole = f"<body><article>{prose[0]}{names}{wrapped}{prose[1]}{names}</article></body>"
    assert html_text.main_text(whole).count("Second linked name") == 2 and "a long linked title of a source" in html_text.main_text(whole)
    between = html_text.main_text(f"<body><div>{menu}{prose[0]}{names}{wrapped}{prose[1]}{around}</div></body>")
    assert between.count("Second linked name") == 1 and "a long linked title of a source" in between and "Site links" not in between and "Title" in between


MENU_WORDS = set(re.sub("<[^>]*>", " ", MENU).split())
PROSE = ["".join(f"{w}{i} " for i in range(40)).strip() + "." for w in ("first", "second", "third")]
PARAGRAPHS = "".join(f"<p>{p}</p>" for p in PROSE)


@pytest.mark.parametrize(
    "page",
    [
        f'<body><div class="content has-sidebar">{PARAGRAPHS}</div></body>',
        f'<body><div class="site with-nav"><div class=x>{PARAGRAPHS}</div></div></body>',
        f'<body><div class="wrapper share-enabled"><article>{PARAGRAPHS}</article></div></body>',
        f"<body><a title=Bob's href=/x>Bob</a><div data-of=it's>{PARAGRAPHS}</div><p class='ad'>Buy</p></body>",
        f'<body><div class="sidebar wrapper"><h1 hidden>T</h1><main>{PARAGRAPHS}</main></div></body>',
        f"<body><form action=/all><input name=state><h1 hidden>x</h1><div><article>{PARAGRAPHS}</article></div></form></body>",
        f'<body><div data-note="class=ad id=menu">{PARAGRAPHS}</div></body>',
        f"<body><div class=a>{MENU}</div><div class=b>{PARAGRAPHS}</div><div class=c>{MENU} A line of the page.</div></body>",
        f"<table><tr><td>{MENU}<td>{PARAGRAPHS}<td>{MENU}</table>",
        f"<body><div class=q1>{MENU}</div><div class=q2><div class=q3>Buy this now, it is cheap.</div><div class=q4>{PARAGRAPHS}</div></div></body>",
    ],
)
def test_densities_choose_where_names_tell_nothing(page):
    assert html_text.main_text(page) == "\n".join(PROSE)


def test_pages_without_article_elements():
    """The same text, whatever the element around it is called and however the menus before and after it are."""
    for around in ("div", "section", "td"):
        cells = ("<table><tr>", "</table>") if around == "td" else ("", "")
        page = f"<body><div>{MENU}</div><div>Some words of an advert.</div>{cells[0]}<{around}><h1>Title</h1>{PARAGRAPHS}</{around}>{cells[1]}<div>(c) some one</div></body>"
        assert html_text.main_text(page) == "\n".join(["Title", *PROSE])


def test_parts_of_an_article():
    sections = "".join(f"<section><h2>H{i}</h2><p>{p}</p></section>" for i, p in enumerate([*PROSE, "Short end."]))
    whole = [x for i, p in enumerate([*PROSE, "Short end."]) for x in (f"H{i}", p)]
    assert html_text.main_text(f"<body><div>{MENU}</div><div>{sections}</div></body>") == "\n".join(whole)
    assert html_text.main_text(f"<body><h1>Title</h1><div class=t>{MENU}</div><div><div class=x>{PARAGRAPHS}</div></div></body>") == "\n".join(["Title", *PROSE])
    head = f"<article><header><h1>Title</h1></header>{PARAGRAPHS}<ul><li><a href=/r>A source</a></li></ul></article>"
    assert html_text.main_text(f"<body><header><h2>Site</h2></header>{head}</body>") == "\n".join(["Title", *PROSE, "A source"])
    thread = f"<div class='comment-list'>{PARAGRAPHS * 3}</div>"
    assert html_text.main_text(f"<body><div class=story>{PARAGRAPHS}</div>{thread}</body>") == "\n".join(PROSE)


@pytest.mark.parametrize(
    "page",
    [
        f"<body><form action=/all><input name=__state><div id=x>{MENU}</div><div>{PARAGRAPHS}</div></form></body>",
        f"<body><form action=/all>{PARAGRAPHS}</form><div>(c) 2020</div></body>",
        f"<body><div class=social>{PARAGRAPHS}</div></body>",
        f"<body><div>{MENU}</div><div class=social>{PARAGRAPHS}<div class=ad>Buy this now.</div></div></body>",
        f"<body><nav>{MENU}</nav><div class=banner><div class=widget>{PARAGRAPHS}</div></div><footer>(c)</footer></body>",
        "<body>" + "".join(f"<div class=notice><p>{p}</p></div>" for p in PROSE) + "</body>",
    ],
)
def test_names_never_lose_a_page(page):
    assert html_text.main_text(page) == "\n".join(PROSE)


def test_names_still_tell_where_other_text_is():
    form = "<form><p>Your mail address</p><input name=mail><button>Send</button></form>"
    assert html_text.main_text(f"<body><div>{PARAGRAPHS}</div>{form}<div class=social>Share this with all your friends now</div></body>") == "\n".join(PROSE)
    links = "".join(f"<li><a href=/{i}>Linked title {i}</a></li>" for i in range(4))
    assert html_text.main_text(f"<body><div class=navbar>{MENU}</div><div><ul>{links}</ul></div></body>").count("Linked title") in (0, 4)
    assert MENU_WORDS.isdisjoint(html_text.main_text(f"<body><div class=navbar>{MENU}</div><div><ul>{links}</ul></div></body>").split())


def test_sources_at_the_end_stay():
    links = "<ul><li><a href=/a>A first source</a></li><li><a href=/b>A second source</a></li></ul>"
    for heading in ("References", "Quellen", "Further reading"):
        for listed in (f"<h2>{heading}</h2>{links}", f"<div class=refs><h2>{heading}</h2>{links}</div>"):
            got = html_text.main_text(f"<body><div class=story>{PARAGRAPHS}{listed}</div></body>")
            assert got == "\n".join([*PROSE, heading, "A first source", "A second source"])
    assert "source" not in html_text.main_text(f"<body><div class=story>{PARAGRAPHS}<h2>More on this site</h2>{links}</div></body>")


def test_names():
    furniture = "ad ad-0 site-header cookie_notice comment-list2 comment-form nav-links Sidebar-Inner share".lower().split()
    assert all(map(html_text._names_furniture, furniture))
    assert not any(map(html_text._names_furniture, "has-sidebar share-enabled header-less content post-body no-ads adventure 7 main".split()))


def brute_counts(node):
    """Characters, tags, link characters and link tags below a node, by walking it anew."""
    chars = tags = link_chars = link_tags = 0
    for c in node.children:
        if isinstance(c, str):
            chars += len(re.sub(r"\s", "", c))
        elif not c.never:
            a, b, d, e = brute_counts(c)
            chars, tags, link_chars, link_tags = chars + a, tags + b + 1, link_chars + d, link_tags + e + (c.tag == "a")
    return chars, tags, chars if node.tag == "a" else link_chars, link_tags


def ancestors(node):
    return [] if node is None else [node, *ancestors(node.parent)]


def test_densities_by_brute_force():
    rng = np.random.default_rng(13)
    for _ in range(60):
        parts = [str(rng.choice(["<div>", "</div>", "<p>", "<a href=x>", "</a>", "words and words ", "<b>", "</b>", "<nav>", "</nav>", "<span>x</span>"])) for _ in range(60)]
        root = html_text.parse("<body>" + "".join(parts))
        order = html_text.measure(root)
        page = brute_counts(root)
        want = {}
        for node in order:
            c, t, lc, lt = brute_counts(node)
            value = 0.0
            if c:
                base = np.log(c / max(c - lc, 1) * lc + page[2] / max(page[0], 1) * c + np.e)
                value = c / max(t, 1) * max(0.0, np.log(c / max(lc, 1) * max(t, 1) / max(lt, 1)) / (np.log(base) if base > 1 else 1))
            want[id(node)] = value
            assert node.density == pytest.approx(value)
        for node in order:
            own = sum(len(re.sub(r"\s", "", c)) for c in node.children if isinstance(c, str))
            assert node.total == pytest.approx(own + sum(want[id(c)] for c in node.children if not isinstance(c, str) and not c.never))
        blocks, keep = [n for n in order if n.tag in html_text.BLOCK or n is root], html_text.article(root)[0]
        most = max(n.total for n in blocks)
        assert any(keep in ancestors(n) for n in blocks if n.total == pytest.approx(most))


def test_broken_markup():
    assert html_text.main_text("<article><h1>T</h1><p><b>Bold text.<br><p>Next one.</p><p>Last &lt;tag&gt; &eacute;</article><footer>x</footer>") == "T\nBold text.\nNext one.\nLast <tag> é"
    assert html_text.main_text("<article><p>Cut off in the mid") == "Cut off in the mid"
    assert html_text.main_text("<article><p>Open tag <a href='x") == "Open tag"
    assert html_text.main_text("plain text < 5 & more") == "plain text < 5 & more"


def test_densities_decide_on_the_pages_at_hand():
    """Neither the article element nor any name is needed: the text is the same without them."""
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist()
    assert pages
    for page in filter(None, pages):
        bare = re.sub(r"(</?)article", r"\1div", page).replace('class="ad"', 'class="x"')
        if len(html_text.main_text(page)) > 500:  # an article shorter than its advert is told by names alone
            assert html_text.main_text(bare) == html_text.main_text(page) != ""


def test_pages_without_text(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<html></html>"), (None, "u", "<p>x</p>"), (4, "u", "<p>" + "word " * 100_000), (5, "u", "<div>" * 30_000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()}
    assert got[1] == got[2] == got[3] == ("", 0) and got[None] == ("x", 1) and got[4][1] == 499_999 and got[5] == ("deep", 4)
    assert html_text.extract(pages.limit(0)).count() == 0


# The pipeline


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(8)
    words = ["river", "stone", "water", "light", "under", "the", "and", "of", "lamp", "ring", "cloud", "field"]
    good = [" ".join(rng.choice(words, 80)) + f" {i}" for i in range(60)]
    leak = " ".join(rng.choice(words, 14))
    texts = good + [" ".join(w.upper() + "!!" for w in rng.choice(words, 80)) for _ in range(12)]
    texts += [good[0], good[0].replace(" ", "  "), good[1] + " extra", good[2][:100] + " " + leak + " " + good[2][100:], None, ""]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(3, good[3], "en", "s", 0), (None, None, None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 72)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if n < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        kept[name] = sorted((r["doc_id"] for r in docs.select("doc_id").collect()), key=str)
    ids = {k: set(v) for k, v in kept.items()}
    assert set(range(60)) <= ids["quality"] and not ids["quality"] & set(range(60, 72))
    assert {0, 1, 2, 3, 75} <= ids["exact_copies"] and not ids["exact_copies"] & {72, 73} and len(kept["exact_copies"]) == len(ids["exact_copies"])
    assert set(range(60)) <= ids["near_copies"]
    assert 75 not in ids["benchmark_leaks"] and set(range(60)) <= ids["benchmark_leaks"]
    assert ids["packing"] == ids["benchmark_leaks"]


def test_stages_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
