import random

from coppice.llm import fm_decontam


def by_hand(text, items, n):
    """All windows of all items are found in the same text and cut at once, until none is left."""
    pats = {tuple(line[i : i + n]) for t in items if (line := t.split()) for i in range(max(1, len(line) - n + 1))}
    words = text.split(" ")
    while True:
        hit = {i + k for p in pats for i in range(len(words) - len(p) + 1) if tuple(words[i : i + len(p)]) == p for k in range(len(p))}
        if not hit:
            return [w for w in words if w]
        words = [w for i, w in enumerate(words) if i not in hit]


def test_blocks_change_no_text(spark, monkeypatch):
    rng = random.Random(9)
    items, docs = [], []
    for k in range(5):
        w = [f"w{k}x{i}" for i in range(15)]
        items += [" ".join(w), " ".join(w[:12])]  # an item whose first words another item shares
        docs.append(" ".join(["before", *w, "after"]))
        a, b, c = ([f"{x}{k}y{i}" for i in range(11)] for x in "abc")
        items += [" ".join(a), " ".join(b), " ".join(c)]  # one inside another, twice over
        docs.append(" ".join(["before", *a[:5], *b[:6], *c, *b[6:], *a[5:], "after"]))
    items += ["c d e", "a b x y z w q r s t"]  # the cut of the one joins the other
    docs.append("a b x y z c d e w q r s t")
    docs += [" ".join(rng.choices(docs[0].split(), k=40)), "clean words", "", None]
    frame = spark.createDataFrame([(i, t, "kept", i) for i, t in enumerate(docs)], "doc_id long, text string, _spans string, items long").repartition(3)
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    whole = {r["doc_id"]: tuple(r) for r in fm_decontam.cleaned(frame, benchmark).collect()}
    for size in (750, 100):
        monkeypatch.setattr(fm_decontam, "BLOCK_BYTES", size)
        assert len(fm_decontam.blocks(benchmark, 10)) > 1
        monkeypatch.setattr(fm_decontam, "GROUP_BYTES", 500)
        out = fm_decontam.cleaned(frame, benchmark)
        assert out.columns == frame.columns
        assert {r["doc_id"]: tuple(r) for r in out.collect()} == whole
    assert len(whole) == len(docs)
    assert all((r[1] or "").split() == by_hand(docs[i] or "", items, 10) and r[2:] == ("kept", i) for i, r in whole.items())
    assert whole[len(docs) - 1][1] is None
