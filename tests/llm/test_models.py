"""Learned operators on held-out rows, formats by round trips, the pipeline against a plain one."""

import gzip
import math
import random
import re
import time
import zlib
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tests.conftest import SMALL
from wordsonar.llm import bpe, chat, langid, queries, toxicity, warc

from . import brute
from .conftest import EDGE
from .test_near import check as near_check


def area(score, y):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    return (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_toxicity(spark):
    larger = "/root/testdata/sf0.01"
    scored = {r.doc_id: r for r in queries.op1_toxicity(spark, larger).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in scored.items())
    marks = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{larger}/labels.parquet").collect()]
    held = [(scored[i].score, y) for i, y in marks if scored[i].held_out]
    assert len(scored) == 1000 and area(*map(np.array, zip(*held, strict=True))) > 0.9


def test_toxicity_edges(spark, edge, none):
    marks = spark.createDataFrame([(5, 1), (7, 0), (8, 0), (3, 1), (3, 1), (0, 0), (None, 1), (9, 5), (11, None)], "doc_id bigint, toxic int")
    for labels in (marks, marks.limit(0), marks.where("toxic = 1")):
        model = toxicity.learn(edge, labels)
        assert toxicity.score(edge, model).where("score between 0 and 1").count() == len(EDGE) and toxicity.score(none, model).count() == 0


def test_toxicity_frequent_id(spark):
    docs = spark.createDataFrame([(k if k < 60 else 7, f"you fool {k}" if k % 2 else f"a fine day {k}") for k in range(400)], "doc_id bigint, text string")
    marks = spark.createDataFrame([(k if k < 60 else 7, k % 2) for k in range(400)], "doc_id bigint, toxic int")
    seen = []
    whole = toxicity._features
    toxicity._features = lambda rows, lexicon: seen.append(rows.count()) or whole(rows, lexicon)
    try:
        model = toxicity.learn(docs, marks)
    finally:
        toxicity._features = whole
    assert seen == [61]  # 60 ids, of which one has both labels
    scores = {r.doc_id: r.score for r in toxicity.score(docs.where("doc_id < 60 and doc_id <> 7"), model).collect()}
    assert min(scores[k] for k in range(1, 60, 2) if k != 7) > max(scores[k] for k in range(0, 60, 2))


def test_toxicity_features():
    names = toxicity.NAMES
    f = lambda t: dict(zip(names, toxicity.Lexicon({"grue": 2.0}).features(t), strict=True))
    assert f("you idiot grue")["insults"] > 0 and f("you idiot")["near_you"] > 0 and f("idiot " + "x " * 9 + "you")["near_you"] == 0
    assert f("an 1d!ot here")["odd_hits"] > 0 and f("SHOUT")["shouted"] > 0 and not any(f("").values())


def test_isotonic():
    x = np.arange(200.0)
    y = (np.random.default_rng(0).random(200) < x / 200).astype(float)
    fitted = toxicity.Isotonic().fit(x, y)(x)
    assert (np.diff(fitted) >= 0).all() and fitted[0] < 0.3 < 0.7 < fitted[-1]


def test_boosting():
    r = np.random.default_rng(1)
    x = r.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    raw = toxicity.Boosted(60).fit(x[:1500], y[:1500]).raw(x[1500:])
    assert ((raw > 0) == y[1500:]).mean() > 0.97


def slow_ranks(text, size):
    """The most frequent n-grams of a text, one at a time."""
    counts = {}
    code = lambda c: ord(c) % 16381 + 1 if c.isalpha() else 0
    low = " " + text.lower() + " "
    for i in range(1, len(low) - 1):
        b, one, a = code(low[i - 1]), code(low[i]), code(low[i + 1])
        if not one:
            continue
        for g in [one, (one << 14 | a) + (1 << 42), (b << 28 | one << 14 | a) + (2 << 42)] + ([one + (1 << 42)] if not b else []):
            counts[g] = counts.get(g, 0) + 1
    return sorted(counts, key=lambda g: (-counts[g], g))[:size]


def test_ranks(texts):
    some = [t for _, t in texts[:6]] + ["", "é É!", "aaa"]
    ranked = langid.Ranked(some, 50)
    for k, t in enumerate(some):
        mine = ranked.doc == k
        assert ranked.code[mine][np.argsort(ranked.rank[mine])].tolist() == slow_ranks(t, 50)


def test_distances(texts):
    profiles = {"a": slow_ranks(texts[0][1], 60), "b": slow_ranks(texts[1][1], 60)}
    names, scores = langid.Profiles(profiles, 60).predict([t for _, t in texts[:20]])
    for (_, t), name, score in zip(texts[:20], names, scores, strict=True):
        own = slow_ranks(t, 60)
        far = {k: sum(abs(p.index(g) - r) if g in p else 60 for r, g in enumerate(own)) for k, p in profiles.items()}
        assert far[name] == min(far.values()) and score == pytest.approx(1 - far[name] / (len(own) * 60))


def test_language(spark, docs):
    lang = {r.doc_id: r.lang for r in docs.collect()}
    found = queries.op5_language(spark, SMALL).collect()
    held = [r for r in found if r.held_out]
    assert len(found) == len(lang) and {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in found)


def test_language_edges(spark, docs, edge, none):
    profiles = langid.learn(docs)
    found = {r.row: r for r in langid.predict(edge, profiles).collect()}
    assert len(found) == len(EDGE)
    for k, (_, t) in enumerate(EDGE):
        assert (found[k].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= found[k].score <= 1
    assert langid.predict(none, profiles).count() == 0
    assert {r.lang_pred for r in langid.predict(edge, langid.learn(docs.limit(0))).collect()} == {"und"}
    labelled = spark.createDataFrame([(None, "en"), ("word", None), ("", "fr")], "text string, lang string")
    assert langid.predict(edge, langid.learn(labelled)).count() == len(EDGE)


def turns_of(some):
    return brute.sha("".join(f"{r or ''}\n{t or ''}\n" for _, r, t in some))


def test_chat(spark):
    table = spark.read.parquet(f"{SMALL}/conversations.parquet")
    by = {-7: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in table.orderBy("turn").collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    for r in queries.op7_chat(spark, SMALL).collect():
        said = "".join(t for _, role, t in by[r.conv_id] if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(by[r.conv_id]), turns_of(by[r.conv_id]), len(said), brute.sha(said))
        by.pop(r.conv_id)
    assert not by


def test_chat_edges(spark):
    some = [(1, 0, "user", None), (1, 1, None, "x</s>"), (1, None, "assistant", "\\"), (None, 3, "assistant", "a"), (None, 3, "assistant", "a"), (2, 0, "<<ROLE>>", "[INST]"), (3, 0, "assistant", "é😀" * 9000)]
    df = spark.createDataFrame(some, "conv_id bigint, turn bigint, role string, text string")
    found = {r.conv_id: r for r in chat.report(chat.rendered(df)).collect()}
    order = lambda c: sorted(((t, r or "", x or "") for i, t, r, x in some if i == c), key=lambda y: (y[0] is not None, y[0] or 0, y[1], y[2]))
    assert {c: (r.n_turns, r.turns_sha256) for c, r in found.items()} == {c: (len(order(c)), turns_of(order(c))) for c in (1, 2, 3, None)}
    assert chat.report(chat.rendered(df.limit(0))).count() == 0
    for r in chat.rendered(df).where("role = 'assistant'").collect():
        assert chat.unescape(r.formatted[r.loss_start : r.loss_end]) == r.text


def test_chat_grammar():
    r = random.Random(3)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "<<ROLE>>", "<</ROLE>>", "\\", "a", " ", "\n", "<", "[", "s>", "/", "é", "😀"]
    for _ in range(4000):
        turns = [(r.choice(["user", "assistant", "system", "", "<</ROLE>>x", "\\"]), "".join(r.choice(parts) for _ in range(r.randint(0, 7)))) for _ in range(r.randint(1, 4))]
        line = "".join(chat.render(*t) for t in turns)
        assert [(role, text) for role, text, _ in chat.parse_all(line)] == turns
    with pytest.raises(ValueError):
        chat.parse("<s>open")
    assert "</s>" not in chat.render("assistant", "</s>")[3:-4].replace("\\</s>", "")


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.text, self.deep = [], 0

    def handle_starttag(self, tag, attrs):
        self.deep += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.deep -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.deep:
            self.text.append(data)


def test_warc(spark):
    found = {}
    for r in warc.derive(warc.responses(spark.read.parquet(f"{SMALL}/pages.parquet"))).collect():
        found.setdefault(r.page_id, {})[r.warc_type] = r
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert len(found) == len(pages)
    for p in pages:
        meta, conv = found[p.page_id]["metadata"], found[p.page_id]["conversion"]
        plain = Plain()
        plain.feed(p.html)
        assert "".join(conv.block.decode().split()) == "".join("".join(plain.text).split())
        for r in (meta, conv):
            fields, block = warc.parse(bytes(r.record))
            assert block == bytes(r.block) and fields["warc-refers-to"] == r.refers_to and fields["warc-target-uri"] == p.url and fields["warc-type"] == r.warc_type
            assert fields["warc-block-digest"] == warc.digest(block) and fields["warc-source-payload-digest"] == "sha256:" + brute.sha(p.html) and int(fields["content-length"]) == len(block)
        assert meta.refers_to == conv.refers_to and meta.record_id != conv.record_id and b"http-status: HTTP/1.1 200 OK" in bytes(meta.block)
        assert len(re.findall(rb"outlink: ", bytes(meta.block))) >= 1
    report = queries.op2_warc(spark, SMALL)
    assert report.count() == 2 * len(pages) and {r.block_digest for r in report.collect()} == {warc.digest(bytes(x.block)) for y in found.values() for x in y.values()}


def test_warc_edges(spark):
    page = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html; charset=latin-1\r\nX-A: b\r\n\r\n<p>caf\xe9<!-- no --><script>x</script><br>&lt;b&gt; <style>open"
    head = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "http://a/b"), ("WARC-Payload-Digest", "sha1:ABC")]
    some = [warc.record(head, page), None, b"", b"junk", warc.record([("WARC-Type", "request")], b"x"), warc.record([("WARC-Type", "response")], b""), warc.record(head, page)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(some)], "page_id bigint, record binary")
    rows = sorted(warc.derive(df).collect(), key=lambda r: (r.page_id, r.warc_type))
    assert [(r.page_id, r.warc_type) for r in rows] == [(k, t) for k in (0, 5, 6) for t in ("conversion", "metadata")]
    assert rows[0].block.decode() == "café\n<b>" and rows[0].source_digest == "sha1:ABC" and rows[0].record == rows[4].record and b"source-x-a: b" in bytes(rows[1].block)
    assert rows[2].block == b"" and rows[2].refers_to is None and warc.derive(df.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, None, None), (2, "http://x/a b", "<p>1"), (None, "u", "x")], "page_id bigint, url string, html string")
    assert warc.derive(warc.responses(pages)).count() == 6


def windows_of(text, size=13):
    w = brute.item_words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def test_pipeline(spark, docs):
    """Every stage against brute force over its own input, and run() against the stages one after another."""
    import corpus_pipeline

    stages, given, now = dict(corpus_pipeline.STAGES), {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SMALL).cache()
        given[name] = [(r.doc_id, r.text) for r in now.collect()] if name != "tokenize" else {r.doc_id: r for r in now.collect()}
    assert list(stages) == list(given)
    found = langid.predict(docs, langid.learn(docs)).where("lang_pred <> 'und'").collect()
    assert sorted(given["language_id"]) == sorted((r.doc_id, r.text) for r in found)
    near_check(given["language_id"], given["near_dedup"])
    assert len(given["near_dedup"]) < docs.count()
    before = given["near_dedup"]
    cut = [(i, t if len(w) == len(k) else b" ".join(k).decode()) for (i, t), (w, k) in zip(before, brute.kept_words([t for _, t in before]), strict=True)]
    assert sorted(given["substring_dedup"]) == sorted(cut)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    every = set().union(*(windows_of(t) for _, t in items))
    bad = {i for i, _, _, _, c in brute.decontaminated(cut, items) if c} | {i for i, t in cut if windows_of(t) & every}
    assert sorted(given["decontaminate"]) == sorted((i, t) for i, t in cut if i not in bad) and bad
    assert not any(windows_of(t) & every for _, t in given["decontaminate"])
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    coded = given["tokenize"]
    assert len(coded) == len(given["decontaminate"])
    for i, t in given["decontaminate"]:
        assert coded[i].ids == encoding.encode_ordinary(t) and coded[i].decoded_sha256 == brute.sha(t)
    assert {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()} == coded


def test_no_window_of_an_item_is_left(spark):
    import corpus_pipeline

    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    passage = " ".join(items[0].split()[:14])
    own = [" ".join(f"x{k}y{j}" for j in range(2000)) for k in range(3)]
    rows = [(1, f"{own[0]} {passage} {own[1]}"), (2, own[2]), (3, " ".join(items[0].split()[:12]) + " " + own[1])]
    kept = corpus_pipeline.decontaminate(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SMALL).collect()
    assert sorted(r.doc_id for r in kept) == [2, 3]


def test_pipeline_edges(spark, edge):
    import corpus_pipeline

    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string, _row int, label int"
    some = spark.createDataFrame([(i, t, "xx" if k % 2 else None, None, None, "e", k, 1) for k, (i, t) in enumerate(EDGE)], columns)
    for table in (some, some.limit(0)):
        docs = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, SMALL)
            assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == table.columns
        docs.collect()


def test_ranks_in_pieces(texts, monkeypatch):
    some = [t for _, t in texts[:4]] + ["é" * 90, ""]
    whole = langid.Ranked(some, 300)
    monkeypatch.setattr(langid, "SLICE", 37)
    pieces = langid.Ranked(some, 300)
    assert all((getattr(whole, x) == getattr(pieces, x)).all() for x in ("doc", "rank", "code", "count"))


def test_warc_files(spark, tmp_path):
    derived = warc.derive(warc.responses(spark.read.parquet(f"{SMALL}/pages.parquet").limit(20))).orderBy("record_id").cache()
    made = sorted(bytes(r.record) for r in derived.collect())
    for compression in (None, "gzip"):
        at = str(tmp_path / str(compression))
        warc.write(derived.repartition(3), at, compression)
        back = warc.read(spark, at).collect()
        assert all(r.whole for r in back) and len({r.page_id for r in back}) == len(made)
        assert sorted((warc.parse(bytes(r.record)) for r in back), key=repr) == sorted(map(warc.parse, made), key=repr)
    odd = tmp_path / "odd.warc"
    # a block that holds a version line itself, one of another version, one that is cut short
    block = b"HTTP/1.1 200 OK\r\n\r\n<p>\xff\r\n\r\nWARC/1.1\r\nx"
    some = [warc.record([("WARC-Type", "response")], x) for x in (b"", block, b"\xfe<p>ok")]
    odd.write_bytes(b"".join(some[:2]) + some[2].replace(b"WARC/1.1", b"WARC/1.0") + some[2][:-6])
    back = warc.read(spark, str(odd)).orderBy("page_id").collect()
    assert [r.whole for r in back] == [True, True, True, False]
    assert [warc.parse(bytes(r.record))[1] for r in back[:3]] == [b"", block, b"\xfe<p>ok"]
    assert warc.derive(warc.read(spark, str(odd)).where("whole")).where("warc_type = 'conversion'").count() == 3


def test_warc_encoded_bodies():
    text = "<html lang=de><title>é &amp; b</title><p>one<p>two &#99999999999; &#x41;".encode()
    head = lambda *more: "".join(f"{k}: {v}\r\n" for k, v in (("Content-Type", "text/html; charset=utf-8"), *more)).encode()
    chunked = lambda b: b"".join(b"%x;a=b\r\n%s\r\n" % (len(b[k : k + 7]), b[k : k + 7]) for k in range(0, len(b), 7)) + b"0\r\n\r\n"
    raw = zlib.compressobj(wbits=-15)
    bodies = [
        ((), text), ((("Content-Encoding", "gzip"),), gzip.compress(text)), ((("Content-Encoding", "deflate"),), zlib.compress(text)),
        ((("Content-Encoding", "deflate"),), raw.compress(text) + raw.flush()), ((("Transfer-Encoding", "chunked"),), chunked(text)),
        ((("Transfer-Encoding", "chunked"), ("Content-Encoding", "gzip")), chunked(gzip.compress(text))), ((("Content-Encoding", "gzip"),), text), ((("Transfer-Encoding", "chunked"),), text),
    ]
    for more, payload in bodies:
        data = warc.record([("WARC-Type", "response"), ("WARC-Target-URI", "http://a/")], b"HTTP/1.1 200 OK\r\n" + head(*more) + b"\r\n" + payload)
        meta, conversion = warc.derivatives(data)
        assert conversion[5].decode() == "é & b\none\ntwo \ufffd A" and meta[4] == warc.digest(payload)
        assert b"title: \xc3\xa9 & b\r\n" in meta[5] and b"language: de\r\n" in meta[5]


def test_warc_fields_by_brute_force(spark):
    """Title, language and links of every page as the standard library's parser finds them."""

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.title, self.lang, self.links, self.inside = None, None, [], False

        def handle_starttag(self, tag, attrs):
            own = dict(reversed(attrs))
            if tag == "a" and own.get("href") is not None:
                self.links.append(own["href"].strip())
            if tag == "html" and self.lang is None:
                self.lang = own.get("lang")
            if tag == "title" and self.title is None:
                self.inside, self.title = True, ""

        def handle_endtag(self, tag):
            self.inside &= tag != "title"

        def handle_data(self, data):
            if self.inside:
                self.title += data

    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    blocks = {r.page_id: bytes(r.block).decode() for r in warc.derive(warc.responses(spark.read.parquet(f"{SMALL}/pages.parquet"))).where("warc_type = 'metadata'").collect()}
    assert len(blocks) == len(pages)
    for i, p in pages.items():
        plain = Plain()
        plain.feed(p.html)
        lines = blocks[i].split("\r\n")
        said = lambda name: [x.partition(": ")[2] for x in lines if x.startswith(f"{name}: ")]
        assert said("title") == ([" ".join(plain.title.split())] if plain.title is not None else [])
        assert said("language") == ([plain.lang] if plain.lang else [])
        assert said("outlink") == [" ".join(urljoin(p.url, x).split()) for x in dict.fromkeys(plain.links)]


LONG_ODD = {
    "one word": "a" * 1_000_000, "letters": "".join(random.Random(4).choices("abcdefghijklmnopqrstuvwxyz", k=100_000)), "signs": "a1.@" * 250_000, "tags": "<html " * 170_000, "titles": "<title>" * 140_000,
    "declarations": "<!" * 500_000, "links": "<a " + "href=" * 200_000 + ">", "number": "&#" + "9" * 1_000_000, "scripts": "<script " * 125_000, "dots": "a." * 500_000,
}


@pytest.mark.parametrize("kind", sorted(LONG_ODD))
def test_long_odd_texts_take_linear_time(kind):
    text, began = LONG_ODD[kind], time.process_time()
    toxicity.Lexicon({"word": 1.0}).features(text)
    assert len(warc.derivatives(warc.record([("WARC-Type", "response")], b"HTTP/1.1 200 OK\r\n\r\n" + text.encode()))) == 2
    assert time.process_time() - began < 15


def test_chat_is_parsed_as_one_text():
    """Cut anywhere, a conversation's formatted text gives the same turns; what is plain stays plain; a wrong mask is found."""
    r = random.Random(9)
    for _ in range(300):
        turns = [(r.choice(["user", "assistant", "tool"]), "".join(r.choice(["</s>", "[INST]", "\\", "a", "<", "<s", "[/INST]"]) for _ in range(r.randint(0, 5)))) for _ in range(r.randint(1, 5))]
        lines = [chat.render(*t) for t in turns]
        whole, cut = chat._Fold(1), chat._Fold(1)
        at = 0
        for (role, _), line in zip(turns, lines, strict=True):
            span = chat.parse(line)[2] if role == "assistant" else (None, None)
            whole.add(line, *span)
            if role == "assistant":
                cut.masks.append((at + span[0], at + span[1]))
            at += len(line)
        text = "".join(lines)
        while text:
            k = r.randint(1, 6)
            cut.add(text[:k], None, None)
            text = text[k:]
        assert whole.row() == cut.row()
        assert whole.row()[1] == len(turns) and whole.row()[3] == sum(len(t) for role, t in turns if role == "assistant")
    assert chat.render("user", "plain [text] < with / all > but control") == "<s>[INST]plain [text] < with / all > but control[/INST]</s>"
    for wrong in ((4, 6), (2, 5)):
        with pytest.raises(ValueError):
            chat._Fold(1).add("<s>abc</s>", *wrong)
    with pytest.raises(ValueError):
        fold = chat._Fold(1)
        fold.add("<s>abc", None, None)
        fold.row()


def slow_counts(text):
    """How often each n-gram stands in a text."""
    counts = {}
    code = lambda c: ord(c) % 16381 + 1 if c.isalpha() else 0
    low = " " + text.lower() + " "
    for i in range(1, len(low) - 1):
        b, one, a = code(low[i - 1]), code(low[i]), code(low[i + 1])
        if one:
            for g in [one, (one << 14 | a) + (1 << 42), (b << 28 | one << 14 | a) + (2 << 42)] + ([one + (1 << 42)] if not b else []):
                counts[g] = counts.get(g, 0) + 1
    return counts


def test_language_by_brute_force(spark, docs):
    """Every prediction and score of the query, with profiles learned one n-gram at a time."""
    rows = {r.doc_id: r for r in docs.collect()}
    own = {i: slow_counts(r.text or "") for i, r in rows.items()}
    by_lang = {}
    for i, r in rows.items():
        if zlib.crc32(str(i).encode()) % 4 != 2 and r.lang is not None and r.text is not None:
            total = by_lang.setdefault(r.lang, {})
            for g, n in own[i].items():
                total[g] = total.get(g, 0) + n
    top = lambda counts: {g: k for k, g in enumerate(sorted(counts, key=lambda g: (-counts[g], g))[:400])}
    profiles = {name: top(counts) for name, counts in sorted(by_lang.items())}
    for r in queries.op5_language(spark, SMALL).collect():
        ranks = top(own[r.doc_id])
        far = {name: sum(abs(p[g] - k) if g in p else 400 for g, k in ranks.items()) for name, p in profiles.items()}
        best = min(far, key=lambda name: (far[name], name))
        expected = (best, 1 - far[best] / (400 * len(ranks))) if ranks else ("und", 0.0)
        assert (r.lang_pred, r.score) == (expected[0], pytest.approx(expected[1]))


def slow_features(text, learned):
    """The features of a text, word by word and character by character."""
    words = re.findall(r"[^\W_](?:[\w@$!|*.'’-]*[\w@$!|*])?", text)
    low = [w.lower() for w in words]
    n, per, each = len(words), 1000 / max(len(words), 1), 1 / max(len(text), 1)
    marked = [k for k, w in enumerate(low) if w in learned or w in toxicity.INSULTS]
    weights = [learned.get(low[k], 0.0) for k in marked]
    you = [k for k, w in enumerate(low) if w in toxicity.YOU]
    near = sum(any(abs(k - j) <= 5 for j in you) for k in marked)
    letter = lambda c: c.isascii() and c.isalpha()
    odd, i = 0, 0
    while i < len(text):
        j, ends = i, 0
        if letter(text[i]) and not (i and letter(text[i - 1])):
            while j < len(text) and letter(text[j]):
                j += 1
            while j < len(text) and text[j] in "@$!|*0123456789":
                k = j
                while k < len(text) and text[k] in "@$!|*0123456789.":
                    k += 1
                if k == len(text) or not letter(text[k]):
                    break
                while k < len(text) and letter(text[k]):
                    k += 1
                j = ends = k
        if not ends and letter(text[i]):
            j, pairs = i + 1, 0
            while j + 1 < len(text) and text[j] in ".*-" and letter(text[j + 1]):
                j, pairs = j + 2, pairs + 1
            ends = j if pairs >= 2 else 0
        odd += ends > 0
        i = ends or i + 1
    plain = str.maketrans("@4310!|$5780", "aaeioiisstbo")
    odd_hits = sum(x in toxicity.INSULTS or x in learned for w in words if not w.isalpha() for x in [re.sub(r"[.*'’-]", "", w.lower().translate(plain))]) if odd else 0
    runs = sum(1 for _ in re.finditer(r"([A-Za-z])\1\1+", text))
    count = lambda signs: sum(c in signs for c in text)
    return [
        np.log1p(n), sum(low[k] in toxicity.INSULTS for k in marked) * per, sum(x > 0 for x in weights) * per, sum(weights) * per, max(weights, default=0.0), np.log1p(len(marked) + odd_hits), near * per,
        len(you) * per, sum(c.isupper() for c in text) * each, sum(len(w) > 1 and w.isupper() for w in words) * per, count("!?") * each, count(".,;:!?-\"'()*#") * each, odd * per, odd_hits * per, runs * per,
        sum(c.isdigit() for c in text) * each, len(text) / max(n, 1),
    ]


def test_toxicity_by_brute_force(spark, docs, texts):
    """Every score of the query: features by hand, trees walked one row at a time, the calibration's line by line."""
    model = toxicity.learn(docs.select("doc_id", "text").where(~queries._held_out(5, 0)), spark.read.parquet(f"{SMALL}/labels.parquet"))
    scored = {r.doc_id: r for r in queries.op1_toxicity(spark, SMALL).collect()}
    trees, scale = model.trees, model.scale
    some = texts + [(None, t) for t in ("", "f4ck1ng a.b.c x1 1x y@@", "é É idi0t you aaa!!!", "a..b-c*d")]
    for i, t in some:
        x = slow_features(t or "", model.lexicon.learned)
        assert x == pytest.approx(model.lexicon.features(t or ""))
        bins = [int(np.searchsorted(e, v)) for e, v in zip(trees.edges, model.lexicon.features(t or ""), strict=True)]
        raw = trees.start
        for features, cuts, leaf in zip(trees.feature, trees.cut, trees.leaf, strict=True):
            node = 0
            for f, c in zip(features, cuts, strict=True):
                node = 2 * node + int(bins[f[node]] > c[node])
            raw += leaf[node]
        k = int(np.searchsorted(scale.x, raw))
        at = scale.y[0] if k == 0 else scale.y[-1] if k == len(scale.x) else scale.y[k - 1] + (scale.y[k] - scale.y[k - 1]) * (raw - scale.x[k - 1]) / (scale.x[k] - scale.x[k - 1])
        expected = min(1.0, max(0.0, at + 1e-4 * math.tanh(raw / 8)))
        if i is not None:
            assert scored[i].score == pytest.approx(expected, abs=1e-9) and scored[i].predicted == (scored[i].score >= 0.5)
