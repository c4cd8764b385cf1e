"""The pipeline against a plain-Python chain of its five decisions."""

import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from docmine.llm import quality, texts
from tests.llm import fixtures as fx

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sentences(rng, n):
    words = lambda k: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(k))
    return [words(rng.randrange(9, 16)).capitalize() + "." for _ in range(n)]


def tables():
    rng = random.Random(8)
    bench = [(i, " ".join(sentences(rng, 3))) for i in range(4)]
    shared = sentences(rng, 1)[0]
    docs = []
    for i in range(40):
        docs.append((" " if i < 4 else "\n").join(sentences(rng, 6)))
    for i in range(0, 12):
        words = docs[i % 4].split(" ")
        words[5 + i] = "edited"
        docs.append(" ".join(words))
    docs += [docs[3], f"{docs[20]}\n{bench[1][1]}", f"{docs[21]}\n{shared}\nhome about links", f"{docs[22]}\n{shared}"]
    docs += [None, "", "menu | home | links", "\n".join(["go go go go go go go."] * 5), bench[2][1]]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(docs)]
    return [*rows, (None, docs[30], "en", "s", 1), rows[7]], bench


def plain(docs, bench):
    rules, kept = quality.LineRules(), []
    for d, t in docs:
        w = fx.WORD.findall(t or "")
        runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        twice = {j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        text, lost, _ = quality.clean_lines(t or "", rules)
        if len(w) >= 10 and 100 * len(twice) <= 20 * len(w) and 100 * lost <= 50 * sum(map(len, w)):
            kept.append((d, text))
    kept = [(d, t) for d, _, _, t in fx.repeated_lines(kept, 10)]
    groups = fx.components(kept, 5, 80)
    kept = [(d, t) for d, t in kept if d is None or groups[d] == d]
    gram = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    items = [t.lower().replace(".", "").split() for _, t in bench]

    def leaks(text):
        w = text.lower().replace(".", "").split()
        return any(
            100 * (gram(w[s : s + len(b)]) & gram(b)).total() >= 80 * (gram(w[s : s + len(b)]) | gram(b)).total()
            for b in items for s in range(len(w))
        )

    return [(d, t) for d, t in kept if d is None or not leaks(t)]


def test_pipeline(spark, tmp_path):
    rows, bench = tables()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d, t in plain([(r[0], r[1]) for r in rows], bench):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for s in range(0, len(ids), 1024):
            want[d, s, len(ids[s : s + 1024]), zlib.crc32(ids[s : s + 1024].tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == want
    filled = defaultdict(int)
    for r in out:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 1024
    assert 30 < len({k[0] for k in want}) < len(rows) - 16  # near copies are gone too


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_an_empty_table(spark, tmp_path, stage):
    empty = spark.createDataFrame([], COLUMNS)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = dict(corpus_pipeline.STAGES)[stage](spark, empty, str(tmp_path))
    assert out.collect() == []
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == empty.columns


def test_a_task_holds_little_beside_a_batch():
    """What the kernels allocate follows the slice, not the batch that Spark sends."""
    words = "some plain words of an ordinary line that ends here. " * 40
    batch = pa.RecordBatch.from_pydict({"_text": [words] * 1500})
    texts.POWERS.__init__()
    peak = 0
    for part in texts.slices(iter([batch]), "_text"):
        tracemalloc.start()
        quality._measure(part, quality.LineRules(), "_text")
        sets = list(texts.shingle_sets(*texts.utf8(part.column("_text")), 5))
        peak = max(peak, tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert len(sets) == part.num_rows
    assert peak < 48 << 20
