import hashlib
import pathlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet
import pytest
from pyspark.sql import functions as F

from coppice.llm import byte_bpe, common, compress_quality, fm_decontam, gru_langid, lpf_dedup, media, tag_paths, tensor_minhash, token_count, trigram_secrets
from coppice.llm.components import components

from . import brute

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs():
    return brute.documents()


@pytest.fixture(scope="module")
def frame(spark, docs):
    return spark.createDataFrame(docs, SCHEMA).repartition(3)


def counted(rows):
    return Counter(map(str, rows))


def test_decontamination(spark, docs, frame, monkeypatch):
    long = docs[6][1].split(" ")
    items = [(1, " ".join(long[50:70])), (2, "One, TWO"), (3, ""), (None, " ".join(long[60:90])), (4, None), (5, "one"), (1, " ".join(long[500:512])), (7, "absent words " * 9)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = counted((i, *brute.contaminated(t, items)) for i, t in docs)

    def got():
        out = fm_decontam.marked(frame.withColumn("items", F.lit("clash")), benchmark)
        return counted((r["doc_id"], r["n_words"], n := sum(s["last"] - s["first"] for s in r["spans"]), len(r["items"]), brute.sha(",".join(r["items"])), n > 0) for r in out.collect())

    assert got() == want
    monkeypatch.setattr(fm_decontam, "BLOCK_BYTES", 400)
    assert got() == want
    clean = fm_decontam.cleaned(frame, benchmark).collect()
    assert len(clean) == len(docs)
    assert not any(brute.contaminated(r["text"], items)[4] for r in clean)
    kept = {r["doc_id"]: r["text"] for r in clean}
    assert all(kept[i] == t for i, t in docs if i is not None and not brute.contaminated(t, items)[4])
    assert fm_decontam.marked(frame, benchmark.limit(0)).where("size(spans) > 0").count() == 0
    assert fm_decontam.marked(frame.limit(0), benchmark).count() == 0


def test_fm_index_counts_and_places():
    rng = np.random.default_rng(2)
    seq = np.append(rng.integers(2, 6, 300), 0)
    index = fm_decontam.FMIndex(seq, 6)
    pats = np.array([seq[i : i + 3] for i in range(0, 250, 7)] + [[5, 5, 1]])
    lo, hi = index.search(pats, np.full(len(pats), 3))
    for p, a, b in zip(pats, lo, hi, strict=True):
        want = [i for i in range(len(seq) - 2) if (seq[i : i + 3] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_media(spark, docs, frame):
    rows = frame.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("n"), media.stored_image(F.col("text")).alias("stored"))
    assert media.media_table(frame).count() == len({(t or "").encode().ljust(-(-max(1, len((t or "").encode())) // 64) * 64, b"\0") for _, t in docs})
    page = F.concat(F.lit("<p>before</p><figure><img src='sha256:"), F.sha2("stored", 256), F.lit("'><figcaption>cap &amp; tion</figcaption></figure><p>after"))
    seq = media.sequences(rows.select("doc_id", "n", page.alias("html")))
    assert [x["kind"] for x in seq.first()["sequence"]] == ["text", "media", "text"]
    out = media.resolved(seq, common.written(media.described(rows))).collect()

    def want(text):
        raw = (text or "").encode()
        payload = raw + bytes((-len(raw)) % 64 or (0 if raw else 64))
        return len(raw), len(payload), brute.sha(payload), zlib.crc32(payload[-64:])

    assert counted((r["doc_id"], r["n"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in out) == counted((i, *want(t)) for i, t in docs)
    assert {(r["position"], r["caption"]) for r in out} == {(1, "cap & tion")}
    stored = bytes(rows.where("doc_id = 95").first()["stored"])
    assert media.samples(stored).tobytes().rstrip(b"\0").decode() == dict(docs)[95]
    lost = media.resolved(seq.limit(1), media.described(rows.limit(0))).collect()
    assert [r["feature"] for r in lost] == [None]
    assert media.sequence(None) == []


ARTICLE = "<article><h1>Title here</h1><p><b>First <i>sentence</i>, with &amp; and\n  spaces.<br>Next line.<p>Second paragraph, which is rather longer than the menus are.</article>"
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body><header><a href=x>Home</a></header>
<nav><ul><li><a>One</a><li><a>Two</a></ul></nav><div class="cookie-notice">We use cookies, as everyone does. Really.</div>{ARTICLE}
<aside class=sidebar>Related stories, many of them.</aside><section id="comments"><p>Nice article, I read it all, twice.</p></section><div class="userComments"><article class="comment"><p>So did I, and it was long, long, long.</p></article></div><form><p>Subscribe, please.</p></form><footer>&copy; 2020, all rights.</footer>"""


def test_tag_paths(spark):
    want = "Title here\n\nFirst sentence, with & and spaces. Next line.\n\nSecond paragraph, which is rather longer than the menus are."
    assert tag_paths.main_text(PAGE) == want
    bare = PAGE.replace("<article>", "<div class=post>").replace("</article>", "</div>")
    assert "Second paragraph" in tag_paths.main_text(bare)
    assert "cookies" not in tag_paths.main_text(bare)
    assert [tag_paths.main_text(x) for x in (None, "", "   ", "<nav>a</nav>", "<p", "<")] == ["", "", "", "", "", "<"]
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    out = tag_paths.extracted(df).orderBy("page_id").collect()
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in out] == [(1, want, len(want)), (2, "", 0), (2, "", 0)]


def test_ratios_decide_also_beside_an_article():
    prose = "A sentence that goes on, with commas, for quite a while; then it ends. " * 4
    page = f"<body><p>{prose}</p><article><h1>Head</h1><p>{prose}</p><p class='share-price'>It cost 5.</p><ul><li>one<li>two</ul><math><mi>x</mi></math><object>fallback</object><svg/><p>after</p></article><div class='cookie-notice'>{prose}</div><footer>{prose}</footer></body>"
    want = [prose.strip(), "Head", prose.strip(), "It cost 5.", "one", "two", "xfallback", "after"]
    assert tag_paths.main_text(page).split("\n\n") == want
    assert tag_paths.main_text(f"<div class='comments'><p>{prose}</p></div>") == ""
    two = f"<body><div class=a><p>{prose}</p></div><div class=b>{'<span>word </span>' * 9}</div></body>"
    assert tag_paths.main_text(two) == prose.strip()
    assert tag_paths.main_text(two, share=0.0) == prose.strip() + "\n\n" + " ".join(["word"] * 9)


def test_fused_ratios_equal_a_plain_version():
    rng = np.random.default_rng(8)
    nodes = [(int(rng.integers(4)), "".join(rng.choice(list("ab .,"), rng.integers(1, 30))), float(rng.choice([1.0, 0.05]))) for _ in range(50)]
    priors = {p: w for p, _, w in nodes}
    nodes = [(p, t, priors[p]) for p, t, _ in nodes]
    weight = lambda k: np.exp(-k * k / 2)

    def smooth(values, i):
        near = [k for k in range(i - 2, i + 3) if 0 <= k < len(values)]
        return sum(weight(k - i) * values[k] for k in near) / sum(weight(k - i) for k in near)

    members = {p: [t for q, t, _ in nodes if q == p] for p in priors}
    text = [w * sum(map(len, members[p])) / len(members[p]) for p, _, w in nodes]
    point = [w * sum(t.count(".") + t.count(",") for t in members[p]) / len(members[p]) for p, _, w in nodes]
    got = tag_paths.fused_ratios(nodes)
    for p in members:
        at = [i for i, (q, _, _) in enumerate(nodes) if q == p]
        assert got[p] == pytest.approx(np.mean([priors[p] * smooth(text, i) * (1 + smooth(point, i)) for i in at]))


def test_main_text_of_made_pages():
    """Pages of several shapes whose article is known: words found against words wanted."""
    rng = np.random.default_rng(12)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) + rng.choice(["", "", "", ",", "."]) for _ in range(n)).capitalize() + "."
    links = lambda n: "<ul>" + "".join(f"<li><a href=x>{prose(2)}</a>" for _ in range(n)) + "</ul>"
    hit = got_n = want_n = 0
    for k in range(60):
        parts = [prose(int(rng.integers(3, 9)))] + [prose(int(rng.integers(15, 80))) for _ in range(int(rng.integers(2, 9)))]
        body = f"<h1>{parts[0]}</h1>" + "".join(f"<p>{x}" for x in parts[1:])
        inner = [f"<article>{body}</article>", f"<div class='post-body'>{body}</div>", f"<main><section>{body}</section></main>", f"<div id=content><div class=text>{body}</div></div>"][k % 4]
        noise = [f"<nav>{links(6)}</nav>", f"<div class='sidebar-left'>{links(5)}<p>{prose(12)}</p></div>", f"<div class=cookieNotice>{prose(30)}</div>", f"<section id=comments><p>{prose(40)}</p><p>{prose(25)}</p></section>", f"<form><p>{prose(9)}</p></form>"]
        rng.shuffle(noise)
        page = f"<html><body><header>{prose(3)}</header>{''.join(noise[:2])}{inner}{''.join(noise[2:])}<footer>{prose(20)}</footer></body></html>"
        got, want = Counter(tag_paths.main_text(page).split()), Counter(" ".join(parts).split())
        hit, got_n, want_n = hit + (got & want).total(), got_n + got.total(), want_n + want.total()
    assert 2 * hit / (got_n + want_n) >= 0.95


def test_ratios_find_the_text_where_names_say_nothing():
    """Pages whose classes mean nothing and that have no article: notices, menus, comments of a line and adverts against the text."""
    rng = np.random.default_rng(21)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) + rng.choice(["", "", "", ",", "."]) for _ in range(n)).capitalize() + "."
    hit = got_n = want_n = 0
    for k in range(80):
        parts = [prose(int(rng.integers(3, 9)))] + [prose(int(rng.integers(25, 90))) for _ in range(int(rng.integers(3, 9)))]
        items = [prose(int(rng.integers(3, 7))) for _ in range(3)]
        body = f"<h2>{parts[0]}</h2>" + "".join(f"<p>{x}</p>" for x in parts[1:]) + "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>"
        noise = [
            "<div class=k1><ul>" + "".join(f"<li><a href=x>{prose(2)}</a>" for _ in range(8)) + "</ul></div>",
            f"<div class=k2><p>{prose(9)}</p></div>",
            f"<div class=k3>{prose(6)}</div>",
            f"<div class=k4><span>{prose(3)}</span> <a href=y>{prose(4)}</a></div>",
            "<div class=k5>" + "".join(f"<p>{prose(7)}</p>" for _ in range(3)) + "</div>",
        ]
        rng.shuffle(noise)
        page = f"<html><body>{''.join(noise[:2])}<div class=q7><div class=z{k % 3}>{body}</div></div>{''.join(noise[2:])}</body></html>"
        got, want = Counter(tag_paths.main_text(page, names=False).split()), Counter(" ".join(parts + items).split())
        hit, got_n, want_n = hit + (got & want).total(), got_n + got.total(), want_n + want.total()
    assert 2 * hit / (got_n + want_n) >= 0.95


def test_ratios_alone_keep_the_text_of_the_given_pages():
    """With no name believed, at least 95 % of the pages have the text that they have with names; and that is the article's own."""
    path = "/root/testdata/sf0.01/pages.parquet"
    if not pathlib.Path(path).exists():
        pytest.skip("no tables here")
    pages = pa.parquet.read_table(path).column("html").to_pylist()
    texts = [tag_paths.main_text(x) for x in pages]
    assert sum(tag_paths.main_text(x, names=False) == y for x, y in zip(pages, texts, strict=True)) >= 0.95 * len(pages)
    assert texts == [tag_paths.main_text(x[x.index("<article") : x.index("</article>")]) for x in pages]


def test_names_inside_an_article():
    prose = "A sentence that goes on, with commas, for quite a while; then it ends. " * 4
    page = f"<body><div><p>We use cookies, as all do.</p></div><article><p>{prose}</p><p class=menu>Soup, fish, cake.</p><aside>A quote.</aside><label>Name it</label><p>{prose}</p><div class=comments><p>I read it.</p></div><form><p>Send</p></form></article></body>"
    assert tag_paths.main_text(page).split("\n\n") == [prose.strip(), "Soup, fish, cake.", "A quote.", "Name it", prose.strip()]


def test_reading_takes_time_in_proportion():
    import time

    for page in ("<b>" * 40_000 + "x.", "<div><b>" * 20_000 + "x." + "</div>" * 20_000, "<article><p>some text here, and more.</article>" * 20_000):
        start = time.time()
        tag_paths.main_text(page)
        assert time.time() - start < 10


def test_media_of_real_pages(spark):

    if not pathlib.Path("/root/testdata/sf0.001/pages.parquet").exists():
        pytest.skip("test tables are not there")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in media.sequences(pages).collect():
        assert [x["position"] for x in r["sequence"]] == list(range(len(r["sequence"])))
        assert all((x["kind"] == "text") == bool(x["text"]) and (x["kind"] == "media") == bool(x["ref"]) for x in r["sequence"])


def test_several_media_of_a_page_stay_in_order(spark):
    page = "<p>one<figure><img src='sha256:a' alt=A><figcaption>cap <b>a</b></figcaption></figure><p>two</p><img src='sha256:b'><figure><img src='sha256:a'><img src='sha256:zz'><figcaption>last</figcaption></figure>end"
    assert [(x["kind"], x["text"], x["ref"], x["caption"]) for x in media.sequence(page)] == [
        ("text", "one", None, None), ("media", None, "sha256:a", "A cap a"), ("text", "two", None, None), ("media", None, "sha256:b", None), ("media", None, "sha256:a", None), ("media", None, "sha256:zz", "last"), ("text", "end", None, None)
    ]
    table = spark.createDataFrame([("a", b"1"), ("b", b"2")], "digest string, payload binary")
    out = media.resolved(media.sequences(spark.createDataFrame([(7, page)], "id long, html string")), table).orderBy("position").collect()
    assert [(r["id"], r["position"], r["digest"], r["payload"] and bytes(r["payload"])) for r in out] == [(7, 1, "a", b"1"), (7, 3, "b", b"2"), (7, 4, "a", b"1"), (7, 5, "zz", None)]


def test_language(spark):
    rng = np.random.default_rng(0)
    make = lambda letters: " ".join("".join(rng.choice(list(letters), 4)) for _ in range(40))
    rows = [(i, make("abcde" if i % 2 else "vwxyzé"), "aa" if i % 2 else "vv") for i in range(120)]
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "", "vv"), (902, "12 !", None), (903, "abc" * 30_000, None)], "doc_id long, text string, lang string")
    texts, langs = gru_langid.sampled(df, 40)
    assert len(texts) < 120
    net = gru_langid.train(texts, langs, steps=60)
    out = {r["doc_id"]: r for r in gru_langid.predicted(df.withColumn("score", F.lit("clash")), net).collect()}
    assert len(out) == 124
    assert np.mean([out[i]["lang_pred"] == lang for i, _, lang in rows]) > 0.95
    assert [out[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert all(0 <= r["score"] <= 1 for r in out.values())
    nothing = gru_langid.train(*gru_langid.sampled(df.limit(0), 40))
    assert {r["lang_pred"] for r in gru_langid.predicted(df, nothing).collect()} == {"und"}


def test_language_gradients():
    net = gru_langid.fresh(["a", "b"], hidden=3, seed=2)
    p = net.params
    x = np.random.default_rng(1).integers(0, 256, (5, 4))

    def loss(q):
        return float(sum((gru_langid.forward(x, q, d).astype(np.float64) ** 2).sum() for d in "fb"))

    grad = {k: np.zeros_like(v, dtype=np.float64) for k, v in p.items()}
    for d in "fb":
        keep: list = []
        out = gru_langid.forward(x, p, d, keep)
        gru_langid.back(x, p, d, keep, 2 * out, grad)
    for name in ("Uf", "cf", "Ef", "Ub"):
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        q = {k: v.copy() for k, v in p.items()}
        step = 1e-2
        q[name][at] += step
        up = loss(q)
        q[name][at] -= 2 * step
        assert (up - loss(q)) / (2 * step) == pytest.approx(grad[name][at], rel=0.05, abs=0.02)


def test_repeated_bytes(spark, docs, frame, monkeypatch):
    want = counted((i, *r) for (i, _), r in zip(docs, brute.repeated([t for _, t in docs], 200), strict=True))
    got = lambda: counted((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in lpf_dedup.removed(frame.withColumn("spans", F.lit(1))).collect())
    assert got() == want
    monkeypatch.setattr(lpf_dedup, "CONTEXTS", 2)  # keys are divided under longer grams
    monkeypatch.setattr(lpf_dedup, "CHUNK", 1500)  # texts are worked through in pieces
    monkeypatch.setattr(lpf_dedup, "HOT_COPIES", 2)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert got() == want
    assert lpf_dedup.removed(frame.limit(0)).count() == 0


def test_first_copies_stay(spark):
    part = "".join(chr(97 + x) for x in np.random.default_rng(6).integers(0, 26, 300))
    df = spark.createDataFrame([(1, part), (2, "x" + part), (3, part + part[::-1])], SCHEMA)
    out = lpf_dedup.removed(df, keep_first=True).collect()
    assert sum(r["n_removed"] for r in out) == 2 * brute.repeated([part, part], 200)[0][1]


def test_factors_equal_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        s = rng.integers(1, 3, rng.integers(2, 45))
        n = len(s)
        common_ = lambda i, j: next((k for k in range(n) if max(i, j) + k >= n or s[i + k] != s[j + k]), n)
        before = [max([0] + [common_(i, j) for j in range(i)]) for i in range(n)]
        after = [max([0] + [common_(i, j) for j in range(i + 1, n)]) for i in range(n)]
        a, b = lpf_dedup.factors(s, 64)
        assert (a.tolist(), b.tolist()) == (before, after)


def test_quality(spark):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(200)]
    good = lambda: " ".join(rng.choice(words, 80)) + "."
    bad = lambda: "!! ".join(w.upper() for w in rng.choice(words, 80))
    rows = [(i, good() if i % 3 else bad()) for i in range(240)]
    df = spark.createDataFrame([*rows, (990, None), (991, ""), (992, good() * 300)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(160)] + [(5, 1), (None, 1), (7, None)], "doc_id long, quality int")
    model = compress_quality.fit(df, labels, "quality", 60)
    out = {r["doc_id"]: r for r in compress_quality.scored(df.withColumn("predicted", F.lit("clash")), model).collect()}
    assert len(out) == 243
    assert np.mean([out[i]["predicted"] == int(i % 3 > 0) for i in range(160, 240)]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())
    assert out[990]["score"] == out[991]["score"]
    one = compress_quality.fit(df, labels.limit(0), "quality", 60)
    assert {r["score"] for r in compress_quality.scored(df, one).collect()} == {0.5}


def test_token_counts(spark, docs, frame):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = [(200, "a\x1cb \x1f c\x85d e　f"), (201, "é ÉCOLE ﬁ Σίσυφος"), (202, "x" * 3000)]
    whole = docs + odd
    df = spark.createDataFrame(whole, SCHEMA)
    want = counted((i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False))) for i, t in whole)
    for huge, chunk, overlap in ((1 << 16, 1 << 15, 1 << 10), (200, 150, 20), (200, 500, 60)):
        out = token_count.token_counts(df.withColumn("n_extra", F.lit(1)), token_count.model_text(path), huge=huge, chunk=chunk, overlap=overlap)
        assert counted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in out.collect()) == want


def test_secrets(spark, docs, frame):
    out = trigram_secrets.scanned(frame.withColumn("spans", F.lit("clash")).withColumn("_x", F.lit(1)))
    base = lambda spans: [(s["start"], s["rank"], s["kind"], s["end"]) for s in spans if s["rank"] < 3]
    rows = out.collect()
    assert counted((r["doc_id"], base(r["spans"])) for r in rows) == counted((i, brute.secrets(t)) for i, t in docs)
    extra = {s["kind"] for r in rows for s in r["spans"]} - {"assign", "access", "hex"}
    assert extra == {"private_key", "slack"}
    clean = out.select("doc_id", trigram_secrets.redacted(F.col("text"), F.col("spans")).alias("text")).collect()
    assert not any(brute.secrets(r["text"]) for r in clean)
    same = {r["doc_id"]: r["text"] for r in clean}
    assert all(same[i] == t for i, t in docs if i is not None and i < 90)
    assert trigram_secrets.scanned(frame.limit(0)).count() == 0


def test_trigram_queries():
    assert trigram_secrets.trigram_query(r"[0-9a-f]{24,}") is None
    assert trigram_secrets.trigram_query(r"AKIA[A-Z0-9]+") == [["aki", "kia"]]
    assert [["key", "my_"]] == trigram_secrets.trigram_query(r"x*my_key\d")
    assert trigram_secrets.trigram_query(r"(ab|c)d?[0-9]") is None


def test_byte_bpe(spark, docs, frame):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        packed = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, packed.splitlines())}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = docs + [(200, "a" * 2000), (201, "é" * 500 + "   \n\n x"), (202, "".join(chr(0x4E00 + i % 300) for i in range(700)))]
    out = byte_bpe.encoded(spark.createDataFrame(whole, SCHEMA).withColumn("ids", F.lit("clash")), packed, public_tokenizers.PATTERN, with_ids=True).collect()
    by = lambda i, ids: (i, len(ids), tuple(ids), brute.sha(" ".join(map(str, ids))))
    assert counted((*by(r["doc_id"], r["ids"]), r["decoded_sha256"]) for r in out) == counted((*by(i, encoding.encode_ordinary(t or "")), brute.sha(t or "")) for i, t in whole)
    assert all((r["n_tokens"], r["ids_sha256"]) == (len(r["ids"]), by(0, r["ids"])[3]) for r in out)


@pytest.mark.parametrize(("words", "percent", "block"), [(3, 85, None), (5, 80, None), (3, 85, 400)])
def test_near_duplicates(spark, docs, frame, monkeypatch, words, percent, block):
    if block:
        monkeypatch.setattr(tensor_minhash, "BLOCK", block)
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    sets, roots = brute.near(docs, words, percent)
    least: dict[int, int | None] = {}
    for (i, _), r in zip(docs, roots, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = counted((i, len(s), least.get(r)) for (i, _), s, r in zip(docs, sets, roots, strict=True))
    assert counted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in tensor_minhash.near_duplicates(frame, words, percent).collect()) == want
    kept = tensor_minhash.deduplicated(frame.withColumn("_extra", F.lit(1)), words, percent).collect()
    assert len(kept) == len(set(roots))
    assert {r["doc_id"] for r in kept if r["doc_id"] is not None} == set(least.values())
    assert tensor_minhash.near_duplicates(frame.limit(0), words, percent).count() == 0


def test_hashes_of_64_bits_may_meet(spark, docs, frame, monkeypatch):
    """Equal first halves of all row ids, and nodes of three bits, change no result."""
    bytes_ = lambda: counted((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in lpf_dedup.removed(frame).collect())
    classes = lambda bits: counted((r["doc_id"], r["n_shingles"], r["component_id"], r["_first"]) for r in tensor_minhash.near_duplicates(frame, 5, 80, bits=bits).collect())
    kept = lambda: counted((r["doc_id"], r["text"]) for r in tensor_minhash.deduplicated(frame).collect())
    want = bytes_(), classes(64), kept()
    monkeypatch.setattr(common, "row_halves", lambda *cols: (F.lit(5).cast("long"), common.row_key(*cols)))
    assert (bytes_(), classes(3), kept()) == want


def test_bands_hold_their_promise():
    for similarity in (0.8, 0.85, 0.95):
        m = tensor_minhash.bands(similarity)
        assert 1 - (1 - (1 - similarity**tensor_minhash.ROWS) ** m) ** 2 <= tensor_minhash.MISS


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(100 + i, 101 + i) for i in range(30)]
    up: dict[int, int] = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes_follow_bytes():
    texts = pa.array(["ab cd", None, "", "ab", "cd ab"], pa.string())
    raw, offsets = common.flat(texts)
    starts, ends, per = common.word_spans(raw, offsets, tensor_minhash.word_table())
    h = common.word_hashes(raw, starts, ends)
    assert per.tolist() == [0, 2, 2, 2, 3, 5]
    assert h[0] == h[2] == h[4]
    assert h[1] == h[3] != h[0]
    assert hashlib.sha256(raw.tobytes()).hexdigest() == brute.sha("ab cdabcd ab")
