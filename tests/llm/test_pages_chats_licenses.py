"""Block labelling, chat templates and license alignment."""

import hashlib
import os
import random

import numpy as np
import pytest

from docmine.llm import chat, html_blocks, license_scan

FOLDER = "/root/testdata/sf0.001"


def test_leaf_blocks():
    page = (
        "<html><head><title>T</title><script>var a='<p>x</p>';</script></head><body><p>One &amp;\n two<br>three"
        "<p>Four <b>bold</b><!-- no --> five</p><ul><li>a<li>b</ul>tail < end<style>p{}</style></body></html>"
    )
    assert [b[0] for b in html_blocks.leaf_blocks(page)] == ["T", "One & two three", "Four bold five", "a", "b", "tail < end"]
    assert html_blocks.leaf_blocks("") == [] and html_blocks.leaf_blocks("<p><b></b>") == []
    assert [b[0] for b in html_blocks.leaf_blocks("plain &lt;b&gt;\xa0text")] == ["plain <b> text"]


def test_formulas_and_drawings_are_walked():
    texts = lambda page: [b[0] for b in html_blocks.leaf_blocks(page)]
    assert texts('<article><p>before</p><svg class="i"/><p>after the icon</p></article>') == ["before", "after the icon"]
    assert texts("<article><p>a <math/> b</p><p>c</p></article>") == ["a b", "c"]
    formula = "<math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math>"
    blocks = html_blocks.leaf_blocks(f"<article><p>That {formula} holds.</p><p>{formula}</p></article>")
    assert [(b[0], b[1][-1][0]) for b in blocks] == [("That E = m c 2 holds.", "p"), ("E = m c 2", "p")]
    icon = '<svg viewBox="0 0 1 1"><g><path d="M0"/><circle r="1"></circle></g></svg>'
    assert texts(f"<p>one {icon} two</p>") == ["one two"]
    blocks = html_blocks.leaf_blocks("<p>one</p><svg><style/><title>Chart</title><text>x <tspan>axis</tspan></text></svg><p>two</p>")
    assert [(b[0], "svg" in [n for n, _ in b[1]]) for b in blocks] == [("one", False), ("Chart", True), ("x axis", True), ("two", False)]
    assert texts("<p>one</p><svg><path d='M0'><p>two</p>") == ["one", "two"]
    assert texts("<p>a</p><script>x<svg></script><template><p>no</p></template><textarea>no</textarea><p>b</p>") == ["a", "b"]


def test_gradient_agrees_with_differences():
    rng = np.random.default_rng(0)
    pages = [rng.normal(size=(n, 5)).astype(np.float64) for n in (3, 1, 6)]
    labels = [rng.random(len(p)) < 0.5 for p in pages]
    model = html_blocks.BlockLabeller(5, hidden=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    _, grad = model.gradient(pages, labels)
    for name, value in model.p.items():
        at = np.unravel_index(int(rng.integers(0, value.size)), value.shape)
        keep, eps = value[at], 1e-2
        value[at] = keep + eps
        up = model.gradient(pages, labels)[0]
        value[at] = keep - eps
        down = model.gradient(pages, labels)[0]
        value[at] = keep
        assert grad[name][at] == pytest.approx((up - down) / (2 * eps), abs=2e-3)


def _page(rng, k):
    line = lambda: " ".join(rng.choice(("alpha", "beta", "gamma", "delta")) for _ in range(9)) + "."
    body = "".join(f"<p>{line()}</p>" for _ in range(3 + k % 4))
    return f'<html><body><nav><a href="#">{line()}</a></nav><article>{body}</article><footer>{line()}</footer></body></html>'


def test_extraction(spark):
    rng = random.Random(1)
    rows = [(i, f"u{i}", _page(rng, i), "x") for i in range(60)] + [(60, None, None, "x"), (None, "u", "", None), (1, "u1", _page(rng, 1), "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_blocks.extract_main_text(pages, sample_pages=40).collect()
    assert len(out) == len(rows)
    truth = sorted(
        "\n".join(b[0] for b in html_blocks.leaf_blocks(h or "") if html_blocks.named_label(b[1], True)) for _, _, h, _ in rows
    )
    assert sorted(r.text for r in out) == truth
    assert all(r.n_chars == len(r.text) for r in out)
    assert html_blocks.extract_main_text(pages.limit(0)).collect() == []


def test_sample_is_full_among_empty_pages(spark, monkeypatch):
    drawn, train = [], html_blocks.train
    monkeypatch.setattr(html_blocks, "train", lambda sample: drawn.append(len(sample)) or train(sample))
    rng = random.Random(4)
    full = [(i, _page(rng, i)) for i in range(30)]
    sparse = full + [(i, ("", None)[i % 2]) for i in range(30, 4000)]
    copies = [(1, full[0][1])] * 300 + [(2, full[1][1])] * 300  # two hashes: the draw may hold neither
    for rows in (sparse, copies):
        pages = spark.createDataFrame(rows, "page_id long, html string").repartition(3)
        out = html_blocks.extract_main_text(pages, sample_pages=20, keep=()).collect()
        assert len(out) == len(rows) and sum(r.n_chars > 0 for r in out) == sum(bool(h) for _, h in rows)
    assert drawn == [20, 20]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
def test_held_out_accuracy(spark):
    pages = [r[0] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("html").collect()]
    model = html_blocks.train(pages[: len(pages) // 2])
    blocks = [html_blocks.leaf_blocks(p) for p in pages[len(pages) // 2 :]]
    found = model.predict(html_blocks.features(blocks))
    wrong = sum(
        int(m) != html_blocks.named_label(b[1], True) for page, mask in zip(blocks, found, strict=True) for b, m in zip(page, mask, strict=True)
    )
    assert wrong <= 0.01 * sum(map(len, blocks))


def test_escapes_are_reversible():
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice("<|\\>n\na") for _ in range(rng.randrange(12)))
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        line = chat.escape_line(t)
        assert chat.unescape_line(line) == t and "\n" not in line and "<|" not in line


def test_template_language():
    out = lambda s, **scope: "".join(p for p, _ in chat.compile_template(s)(scope))
    assert out("a{{ 'b' + 'c' }}{% if x == 1 %}d{% elif x in xs %}e{% else %}f{% endif %}", x=2, xs=[2]) == "abce"
    assert out("{% set y = x + 1 %}{{ y }}{% for i in xs %}{{ i.a | upper }},{% endfor %}", x=1, xs=[{"a": "p"}, {"a": "q"}]) == "2P,Q,"
    assert out("{{ not (1 == 2) and 'yes' or 'no' }}") == "yes"
    assert chat.parse("{% if 1 == 2 %}a{% elif 'x' + 'y' == 'xy' %}b{% else %}c{% endif %}{{ 'q' | upper }}") == [("text", "bQ")]
    for bad in ("{% for x in y %}a", "{% if x %}a", "{{ a.b() }}", "{% endfor %}", "{% foo %}", "{{ }}", "{{ x | nope }}", "{{ $ }}"):
        with pytest.raises(chat.TemplateError):
            chat.parse(bad)
    with pytest.raises(chat.TemplateError):
        out("{{ x.__class__ }}", x=3)


def test_conversations(spark):
    rows = [
        (1, 0, "user", "hi <|im_end|>", "x"), (1, 1, "assistant", "<|im_start|>assistant ok", "x"), (1, 2, "assistant", None, "x"),
        (2, 1, "assistant", "b", None), (2, 0, "us\ner|<|", "a\n", None), (2, 1, "assistant", "a", None), (2, 1, "assistant", "a", None),
        (3, None, None, None, None), (None, 0, "assistant", "é日", None),
    ]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string")
    out = {r.conv_id: r for r in chat.format_conversations(data).collect()}
    assert set(out) == {1, 2, 3, None}
    for conv in out:
        turns = sorted(((t if t is not None else -1), r or "", x or "") for c, t, r, x, _ in rows if c == conv)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert out[conv].n_turns == len(turns)
        assert out[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (out[conv].loss_chars, out[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        text, spans = chat.render_conversation([{"role": r, "text": x} for _, r, x in turns])
        assert out[conv].formatted_chars == len(text)
        assert "".join(chat.unescape(text[a:b]) for a, b in spans) == loss
    assert chat.format_conversations(data.limit(0)).collect() == []


def test_formatted_turns_are_rows(spark):
    rows = [(c, i, ("user", "assistant")[i % 2], f"turn {i} of {c} <|im_end|> é日" if i % 5 else None) for c in (1, 2, None) for i in range(7)]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    formatted = chat.format_turns(data)
    out = formatted.collect()
    assert len(out) == len(rows)
    for conv in (1, 2, None):
        own = sorted((r for r in out if r.conv_id == conv), key=lambda r: r.turn_no)
        assert [r.turn_no for r in own] == list(range(7))
        text, spans, at = "", [], 0
        for r in own:
            spans += [(at + s.start, at + s.end) for s in r.spans]
            text += r.formatted
            at = len(text)
        assert (text, spans) == chat.render_conversation([{"role": r, "text": x or ""} for c, _, r, x in rows if c == conv])
    digests = lambda frame: sorted(frame.collect(), key=str)
    assert digests(chat.read_back(formatted.repartition(4, "turn_no"))) == digests(chat.format_conversations(data))
    framed = chat.format_turns(data, "<s>{% for m in messages %}[{{ m.role }}]{% endfor %}</s>").filter("conv_id = 1").orderBy("turn_no").collect()
    assert [r.formatted for r in framed] == ["<s>[user]", *["[assistant]", "[user]"] * 2, "[assistant]", "[user]</s>"]
    assert chat.format_turns(data.limit(0)).collect() == []


def test_patience_is_a_common_subsequence():
    rng = random.Random(6)
    for _ in range(300):
        a = [rng.randrange(8) for _ in range(rng.randrange(15))]
        b = [rng.randrange(8) for _ in range(rng.randrange(15))]
        pairs = license_scan.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        assert license_scan.patience(a, a) == [(i, i) for i in range(len(a))]
    assert license_scan.increasing([(0, 3), (1, 1), (2, 2), (3, 0), (4, 5)]) == [(1, 1), (2, 2), (4, 5)]


def test_license_scan(spark):
    mit, note = license_scan.LICENSES["mit"], license_scan.LICENSES["mit-note"]
    rows = [
        (1, f"some words. {note} more. {note}"), (2, mit.replace("merge", "fuse").replace("persons", "people")), (3, "nothing here"),
        (4, None), (5, ""), (6, "z " * 5000 + mit.upper() + " z" * 5000), (7, note[:15]), (None, note), (8, "Released under the MIT"), (9, "License. x"),
    ]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, license string").coalesce(1)
    out = sorted(((r.doc_id or 0, r.license, round(r.coverage, 2), r.first_word) for r in license_scan.scan_licenses(docs).collect()))
    assert out == [
        (0, "mit-note", 1.0, 0), (1, "mit-note", 1.0, 2), (1, "mit-note", 1.0, 8), (2, "mit", 0.98, 0), (6, "mit", 1.0, 5000), (8, "mit-note", 0.8, 0),
    ]
    assert license_scan.scan_licenses(docs.limit(0)).collect() == []


def test_every_license_names_itself(spark):
    texts = license_scan.LICENSES
    docs = spark.createDataFrame([(n, f"before it {t} and after") for n, t in texts.items()], "doc_id string, text string").coalesce(1)
    found = {}
    for r in license_scan.scan_licenses(docs).collect():
        found.setdefault(r.doc_id, set()).add(r.license)
        assert r.coverage == 1.0 or r.license != r.doc_id
    assert all(name in found[name] for name in texts)
    # What else is named is a shorter text inside the longer one.
    inside = {"apache-2.0": {"apache-2.0-note"}, "bsd-3-clause": {"bsd-2-clause"}}
    assert {n: f - {n} for n, f in found.items() if f - {n}} == inside


def test_coverage_is_that_of_a_common_subsequence(spark):
    rng = random.Random(8)
    rows = []
    for name, text in license_scan.LICENSES.items():
        words = text.split()
        for k in range(3):
            rows.append((f"{name} {k}", " ".join(w if rng.random() > 0.05 else "changed" for w in words)))
    docs = spark.createDataFrame(rows, "doc_id string, text string").coalesce(1)
    given = dict(rows)
    hashes = {n: license_scan.word_hashes(t).tolist() for n, t in license_scan.LICENSES.items()}
    for r in license_scan.scan_licenses(docs).collect():
        a, b = license_scan.word_hashes(given[r.doc_id]).tolist(), hashes[r.license]
        row = [0] * (len(b) + 1)
        for x in a[r.first_word : r.last_word + 1]:
            before = 0
            for j, y in enumerate(b):
                before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j], row[j + 1])
        assert 0.8 * len(b) <= round(r.coverage * len(b)) <= row[-1]
