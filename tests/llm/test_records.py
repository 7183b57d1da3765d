"""Chat windows, packing, page extraction and WARC archives: round trips and brute force."""

import collections
import hashlib
import html
import os
import random
import re
import zlib

import compare
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from colloquy.llm import chat, packing, site_style, warc
from colloquy.llm.common import shared_folder, stored
from colloquy.llm.oracles import ORACLES
from colloquy.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def test_escapes_are_reversible():
    r = random.Random(1)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<", "[", "\\", "/", "s>", " ", "\n", "x"]
    for _ in range(3000):
        role = r.choice(["user", "assistant", "system", "tool\nx", "", "".join(r.choices(parts, k=3))])
        texts = [(role, "".join(r.choices(parts, k=r.randint(0, 9)))) for _ in range(3)]
        shown = "".join(chat.render(*t)[0] for t in texts)
        assert [x[:2] for x in chat.parse(shown)] == texts
        assert not re.search(r"</?s>|\[/?INST\]|<</?SYS>>", chat.escape(texts[0][1]))


@pytest.mark.parametrize("budget,history", [(40, 12), (2048, 512), (1, 0)])
def test_windows(spark, budget, history):
    r = random.Random(budget)
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "tool"]), r.choice([None, "", "</s> a", "words " * r.randint(1, 30)]), 1)
            for c in (1, 2, 3, None) for t in range(r.randint(1, 40))]
    rows += [(5, 0, "system", "be brief", 1), (5, None, "user", "first", 1), (5, 1, "assistant", "ok", 1), (5, 1, "assistant", "ok", 1)]
    rows += [(6, 0, "assistant", "long " * 40_000, 1)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, window int")
    windows = stored(chat.chat_windows(df, budget=budget, history=history), "w")
    want = collections.defaultdict(list)
    for c, t, role, text, _ in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        want[c].append((role or "", text or ""))
    seen = collections.defaultdict(list)
    for w in sorted(windows.collect(), key=lambda w: (str(w.conv_id), w.window)):
        turns = [x[:2] for x in chat.parse(w.formatted)]
        assert len(turns) == w.n_repeated + w.n_new
        assert w.n_tokens <= budget or w.n_new == 1
        new = turns[w.n_repeated :]
        if w.window and want[w.conv_id][0][0] == "system":
            assert turns[0] == want[w.conv_id][0]
        targets = [chat.unescape(w.formatted[s.start : s.end]) for s in w.loss_spans]
        assert targets == [t for role, t in new if role == "assistant"]
        seen[w.conv_id] += new
    assert seen == want
    got = {x.conv_id: x for x in chat.window_digests(chat.chat_windows(df, budget=budget, history=history)).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        said = "".join(t for role, t in turns if role == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(said))
        assert got[c].turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in turns)) and got[c].loss_sha256 == sha(said)
    assert chat.window_digests(chat.chat_windows(df.limit(0))).collect() == []


@tables
def test_registered_chat(spark):
    turns = collections.defaultdict(list)
    for x in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda x: (x.conv_id, x.turn)):
        turns[x.conv_id].append((x.role, x.text))
    turns[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {x.conv_id: x for x in QUERIES["op2_chat_windows"](spark, SF).collect()}
    assert {c: x.turns_sha256 for c, x in got.items()} == {c: sha("".join(f"{a}\n{b}\n" for a, b in t)) for c, t in turns.items()}
    assert got[-7].loss_chars == 21


def check_packing(rows, capacity):
    use = collections.defaultdict(list)
    for x in rows:
        use[x.sequence_id].append((x.offset, x.length))
    for parts in use.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(use)


@pytest.mark.parametrize("capacity,groups", [(64, 4), (2048, 96)])
def test_packing(spark, capacity, groups):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    r = random.Random(7)
    texts = [None, "", "It's WE'LL <|endoftext|> x", " é́ İ Σς 12 ''", "water " * 9000]
    texts += [" ".join(r.choice(["Water", "stone,", "river!", "don't"]) for _ in range(r.randint(0, 400))) for _ in range(120)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "x", 1), (7, texts[7], 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, length int").repartition(3)
    got = packing.pack(df, packing.word_encoder(path), capacity, groups=groups, with_ids=True).collect()
    tokens = check_packing(got, capacity)
    by_doc = collections.Counter()
    want = collections.Counter()
    for d, t, _ in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), capacity):
            cut = ids[k : k + capacity]
            want[d, k // capacity, k, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()), tuple(cut)] += 1
    for x in got:
        by_doc[x.doc_id, x.piece, x.start, x.length, x.ids_crc32, tuple(x.ids)] += 1
    assert by_doc == want
    total = sum(x.length for x in got)
    assert tokens <= total / capacity * 1.15 + 1
    assert packing.pack(df.limit(0), packing.word_encoder(path), capacity).collect() == []


def test_plans_of_random_histograms():
    r = random.Random(3)
    for _ in range(200):
        capacity = r.randint(2, 70)
        histogram = dict(collections.Counter(r.randint(1, capacity) for _ in range(r.randint(0, 90))))
        segments, n = packing.plan(histogram, capacity, r.randint(1, 9))
        use, got = collections.defaultdict(list), collections.Counter()
        for length, rank, count, sequence, copies, offset in segments.tolist():
            assert rank == got[length]
            got[length] += count
            for t in range(count):
                use[sequence + t // copies].append((offset + t % copies * length, length))
        assert got == histogram and len(use) == n
        for parts in use.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        total = sum(a * b for a, b in histogram.items())
        assert n <= 2 * total / capacity + 1


def page(body):
    return f"<html><head><title>t &amp; t</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_extraction_rules():
    text = lambda s: site_style.parse(s).main_text({})
    nav, foot = "<nav><ul><li><a href=x>Home</a></ul></nav>", "<footer>&copy; me</footer>"
    assert text(page(f"{nav}<article><h1>A  b</h1><p><b>one<br><p>two &lt;x&gt;&nbsp;y\n z</article>{foot}")) == "A b\none\ntwo <x> y z"
    assert text(page(f"<header>h</header><p>one<p>two<div class='cookie-notice'>no</div><form><p>f</form>{foot}")) == "one\ntwo"
    assert text(page("<main>a<aside>x</aside><script>var t='</p>';</script>b<!-- c --></main><p>out")) == "a\nb"
    assert text(page("<article>a<section class='comments'><article class='comment'>me</article></section></article>")) == "a"
    assert text(page("<ul><li>1<li>2<ul><li>3</ul></ul><table><tr><td>4<td>5</table>")) == "1\n2\n3\n4\n5"
    assert text(page("a <span class='ad'>buy</span> b < c & d &am")) == "a\nb < c & d &am"
    assert text("<p>cut <a href='x") == "cut <a href='x"
    assert text(None) == text("") == text("<script>x") == "" and text("<div>" * 3000 + "deep") == "deep"


def test_names_of_wrappers_do_not_empty_an_article():
    text = lambda s: site_style.parse(page(s)).main_text({})
    assert text('<div class="page with-sidebar"><article><p>the article</p></article></div>') == "the article"
    assert text("<form id=aspnetForm><article><p>the article</p></article></form>") == "the article"
    assert text("<form id=aspnetForm><div><p>the text</p></div><div class=nav>Home</div></form>") == "the text"
    assert text('<div class="content no-sidebar"><p>the text</div>') == "the text"
    assert text('<article><div class="article-header"><h1>Title</h1></div><p class="share-price">12</p><p>body') == "Title\n12\nbody"
    assert text('<div class="widget"><div><p>the long text of the page</p></div></div><div class="widget"><p>short</p></div>') == "the long text of the page"
    # Whole names still decide on parts of a page, and comments however long they are.
    assert text('<p>text</p><div class="site-footer">me</div><div class="main-nav">a</div><p>more') == "text\nmore"
    assert text("<p>text</p><section class='post-comments'><p>a comment that is far longer than the text</p></section>") == "text"
    assert text("<section id=comments><article><p>a long comment</p></article></section><div><p>text") == "text"
    assert text("<article><p>text</p></article><aside><article><p>a teaser longer than the text</p></article></aside>") == "text"
    assert text("<p>t</p><nav><p>a menu that is far longer than the text</p></nav>") == "t"


def test_importance_decides_on_names_that_only_contain_a_noise_word(spark):
    body = "<p>a text of its own, longer than the rest of the page, {k}</p><div class='share-price'>{x}</div>"
    rows = [(k, "http://own.example/", page(body.format(k=k, x=f"price {k}"))) for k in range(8)]
    rows += [(100 + k, "http://same.example/", page(body.format(k=k, x="follow us"))) for k in range(8)]
    rows += [(200 + k, "http://few.example/", page(body.format(k=k, x="follow us"))) for k in range(4)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for limit in (10**6, 0):
        for x in site_style.extract(df, broadcast_nodes=limit).collect():
            k, host = x.page_id % 100, x.page_id // 100
            more = [f"\nprice {k}", "", "\nfollow us"][host]
            assert x.text == f"a text of its own, longer than the rest of the page, {k}{more}"


def test_importance_against_its_formula(spark):
    """Random trees: importance of every branch by plain Python."""
    r = random.Random(5)
    sources = []
    for _ in range(30):
        parts = [f"<div class=c{r.randint(0, 3)}><p>{r.choice(['a', 'b', str(r.random())])}</p>" + "<ul></ul>" * r.randint(0, 2) + "</div>" for _ in range(r.randint(1, 4))]
        sources.append(page("".join(parts)))
    df = spark.createDataFrame([("http://h/", s) for s in sources], "url string, html string")
    got = {x.node: x.importance for x in site_style.removed_branches(site_style.style_nodes(df), threshold=2.0).collect()}
    pages, texts, uses, above = (collections.defaultdict(x) for x in (int, collections.Counter, collections.Counter, set))
    for s in set(sources):
        found = site_style.parse(s)
        elements = [e for e in found.elements if not e.noise]
        for n in {e.node for e in elements}:
            pages[n] += 1
        for n, t in {(e.node, t) for e, t in found.blocks}:
            texts[n][t] += 1
        for n, c in {(e.node, tuple(e.children)) for e in elements}:
            uses[n][c] += 1
        for e in elements:
            up = e
            while up is not None:
                above[up.node].add(e.node)
                up = up.parent

    def own(n):
        if pages[n] < site_style.MIN_PAGES:
            return 1.0
        content = 1 - np.mean([np.log(x) for x in texts[n].values()]) / np.log(pages[n]) if texts[n] else 0.0
        shares = np.array(list(uses[n].values())) / sum(uses[n].values())
        return max(content, -(shares * np.log(shares)).sum() / np.log(pages[n]))

    want = {n: max(own(m) for m in below) for n, below in above.items()}
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-9 for n in want)


@tables
def test_pages_that_mark_no_article(spark):
    """The given pages with plain ``div`` in place of ``article``: at least 0.98 of the characters are right."""
    given = spark.read.parquet(f"{SF}/pages.parquet")
    bare = given.withColumn("html", F.regexp_replace("html", "(</?)article>", "$1div>"))
    want = {x.page_id: x.text for x in site_style.extract(given).collect()}
    lines = lambda text: collections.Counter(text.split("\n"))
    right = kept = due = 0
    for x in site_style.extract(bare).collect():
        a, b = lines(x.text), lines(want[x.page_id])
        right += sum(len(t) * n for t, n in (a & b).items())
        kept += sum(len(t) * n for t, n in a.items())
        due += sum(len(t) * n for t, n in b.items())
    print(f"of {due} characters {right} found, of {kept} kept")
    assert right >= 0.98 * due and right >= 0.98 * kept


def test_copies_of_a_page_are_one_page_of_its_host(spark):
    plain = page("<div class=x1><p>same words</p></div>")
    wrapped = page("<div id=page><article><p>the article</p></article></div>")
    rows = [(k, "http://plain.example/", plain) for k in range(7)] + [(10 + k, "http://marked.example/", wrapped) for k in range(7)]
    rows += [(20 + k, "http://two.example/", page(f"<div class=x1><p>text {k % 2}</p></div>")) for k in range(40)]
    # Distinct pages around one article: the wrapper is alike on all, the article stays.
    rows += [(100 + k, "http://own.example/", wrapped + " " * k) for k in range(7)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    want = {i: "same words" if i < 10 else f"text {i % 2}" if 20 <= i < 100 else "the article" for i, *_ in rows}
    for limit in (10**6, 0):  # by broadcast, and by join
        assert {x.page_id: x.text for x in site_style.extract(df, broadcast_nodes=limit).collect()} == want
    assert {(r.kind, r.n) for r in site_style.style_nodes(df.where("page_id < 7")).collect()} == {(0, 1), (1, 1), (2, 1), (3, 1)}


def test_site_styles_remove_what_a_host_repeats(spark):
    rows = []
    for k in range(12):
        rows.append((k, "http://a.example/x", page(f"<div class=x1><p>same words</p></div><div class=x2><p>own text {k}</p><p>more {k}</p></div>")))
        rows.append((100 + k, "http://b.example/y", page(f"<article><p>opening</p><div class=w>fixed</div><p>{k}</p></article>")))
    rows += [(200, "http://few.example/", page("<div class=x1>same words</div>")), (201, None, None), (None, "no url", ""), rows[0]]
    df = spark.createDataFrame([(*x, 1) for x in rows], "page_id bigint, url string, html string, text int")
    for limit in (10**6, 0):  # by broadcast, and by join
        got = collections.Counter((x.page_id, x.text) for x in site_style.extract(df, broadcast_nodes=limit).collect())
        want = collections.Counter()
        for i, url, _ in rows:
            k = (i or 0) % 100
            want[i, "" if i in (None, 201) else "same words" if i == 200 else f"own text {k}\nmore {k}" if i < 100 else f"opening\n{k}"] += 1
        assert got == want
    assert site_style.extract(df.limit(0)).collect() == []


@tables
def test_registered_extraction(spark):
    pages = {x.page_id: x for x in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op9_main_text"](spark, SF).collect()
    assert len(got) == len(pages)
    for x in got:
        article = re.search(r"<article>(.*?)</article>", pages[x.page_id].html, re.S)[1]
        blocks = re.split(r"</?p>|</?h1>", re.sub(r"</?b>", "", article.replace("<br>", " ")))
        want = "\n".join(b for b in (" ".join(html.unescape(b).split()) for b in blocks) if b)
        assert (x.text, x.n_chars) == (want, len(want))


def test_archives(spark):
    same, other = "é" * 600, "b" * 1000
    rows = [(1, "http://a/\r\nX: y", same), (2, None, same), (3, "http://c", other), (4, "http://d", other), (4, "http://d", other)]
    rows += [(5, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (9, "u", "WARC/1.1\r\n\r\nbody\r\n\r\n" * 200), (None, "n", other)]
    df = spark.createDataFrame([(*x, "k") for x in rows], "page_id bigint, url string, html string, payload string").repartition(3)
    path = shared_folder(spark, "warc-test")
    warc.write_warc(warc.page_records(df), path)
    got = sorted(map(tuple, warc.page_report(spark, path).collect()), key=str)
    largest = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            largest[b] = max(i, largest.get(b, i))
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = largest.get(b) if i is not None and i < largest.get(b, i) else None
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if to is not None else "response", to))
    assert got == sorted(want, key=str)
    back = warc.read_warc(spark, path)
    assert {x.payload.decode() for x in back.where("record_type = 'response'").collect()} == {h or "" for _, _, h in rows}
    assert back.where("record_id = 'urn:page:1'").first().target_uri == "http://a/%0D%0AX: y"
    assert back.where("record_type in ('revisit') and refers_to = 'urn:page:2'").count() == 1
    assert warc.read_warc(spark, path, payload=False).where("payload is not null").count() == 0
    empty = shared_folder(spark, "warc-empty")
    warc.write_warc(warc.page_records(df.limit(0)), empty)
    assert warc.page_report(spark, empty).collect() == []


def test_members_of_other_writers(spark, tmp_path):
    import gzip

    records = [warc.record("response", f"urn:page:{i}", "u", "d", None, b"x" * 50_000 * i, 50_000 * i) for i in range(3)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in records))
    got = warc.read_warc(spark, str(tmp_path / "a.warc.gz")).where("record_type = 'response'").collect()
    assert [len(x.payload) for x in got] == [0, 50_000, 100_000]
    assert warc.read_warc(spark, str(tmp_path / "a.warc.gz")).where("record_id = 'urn:page:2'").count() == 1


@tables
def test_archive_against_sql(spark):
    con = compare.connect(SF)
    problems, *_ = compare.differences(spark, con, SF, "op10_warc", QUERIES["op10_warc"], ORACLES["op10_warc"])
    assert not problems


@tables
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"_llm_id": F.lit(1), "root": F.lit("x")})
    extra = docs.limit(1).withColumns({"doc_id": F.lit(None).cast("bigint"), "text": F.lit(None).cast("string")})
    docs = docs.unionByName(docs.limit(3)).unionByName(extra, allowMissingColumns=True)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        before, after = ({(x.doc_id, x.text) for x in d.collect()} for d in (docs, out))
        assert after <= before or name == "secret_scan"
        kept[name], docs = out.count(), out
    labels = {x.doc_id: x.quality for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert not [x.doc_id for x in docs.collect() if labels.get(x.doc_id) == 0]
    items = [x.text for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = [x.text for x in docs.collect()]
    assert not [1 for t in texts for i in items if i in t]
    assert not [1 for t in texts if re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", t)]
    assert len({x.doc_id for x in docs.collect()}) == docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check_packing(packed, 2048)
    assert {x.doc_id for x in packed} == {x.doc_id for x in docs.collect()}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_near_duplicates_stage_keeps_one_row_of_each_group(spark):
    """Ids that are NULL, or stand for several texts; and columns named like the stage's own."""
    text = {c: " ".join(f"{c}{i}" for i in range(100)) for c in "abcde"}
    rows = [(0, text["a"]), (1, text["a"] + " tail"), (1, text["b"]), (None, text["a"] + " x"), (None, text["c"])]
    rows += [(None, text["d"]), (None, text["d"] + " t"), (2, None), (2, None), (3, ""), (9, text["e"]), (9, text["e"] + " more"), (9, text["e"])]
    docs = spark.createDataFrame([(i, t, "z", 5) for i, t in rows], "doc_id bigint, text string, _llm_id string, _llm_n int")
    got = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    # The second word tells texts of one group apart from others.
    assert sorted((str(r.doc_id), (r.text or "-")[:1]) for r in got) == [
        ("0", "a"), ("1", "b"), ("2", "-"), ("3", "-"), ("9", "e"), ("None", "c"), ("None", "d")
    ]
