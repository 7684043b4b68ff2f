"""Near duplicates, search, page text and the pipeline against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import neardup, pagetext, search
from spanloom.llm.components import components
from spanloom.llm.queries import op5_near_duplicates, op9_search


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t):
    w = words(t)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(spark, docs, small):
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    got = {r.doc_id: r.class_id for r in op5_near_duplicates(spark, small).collect()}
    assert set(got) == set(sets)
    where, seen = defaultdict(list), set()
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    members = defaultdict(list)
    for i, c in got.items():
        members[c].append(i)
    for group in where.values():
        for i in group:
            for j in group:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                        assert got[i] == got[j]
    for c, group in members.items():
        assert c == min(group)
        for i in group:
            if len(group) > 1:
                assert max(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in group if j != i) > 0.7


def test_a_large_group_of_near_copies(make, odd):
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(300)]
    texts = []
    for _ in range(200):
        t = list(base)
        t[rng.randrange(300)] = f"x{rng.randint(0, 10 ** 9)}"
        texts.append(" ".join(t))
    texts += ["A  b, c d", "a b c d"] + odd + odd[5:7]
    got = {r.doc_id: r.class_id for r in neardup.classes(make(texts, id=1, class_id=2)).collect()}
    assert {got[i] for i in range(200)} == {0} and got[201] == got[200] == 200
    assert got[202] == 202 and got[203] == 203  # null and empty are classes of their own
    assert got[202 + len(odd)] == got[207] == 207
    assert neardup.classes(make(["a"]).where("false")).count() == 0


def changed(n, size, subs, seed=8):
    """``n`` texts of ``size`` words, each with ``subs`` words of its own."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        t = [f"w{k}" for k in range(size)]
        for p in rng.sample(range(size), subs):
            t[p] = f"x{rng.randint(0, 10 ** 9)}"
        out.append(" ".join(t))
    return out


def kept_links(make, texts):
    """(links of plain similarity 0.8, those inside one class)."""
    sets = [shingles(t) for t in texts]
    got = {r.doc_id: r.class_id for r in neardup.classes(make(texts)).collect()}
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return len(links), sum(got[i] == got[j] for i, j in links)


def test_links_at_the_threshold_in_a_large_bucket(make):
    found, kept = kept_links(make, changed(250, 90, 1))
    assert kept == found > 5000


def test_sparse_links_among_many_texts_just_below_the_threshold(make):
    # a known limit: most pairs are at 0.7, and buckets of over FEW texts aren't compared in full
    found, kept = kept_links(make, changed(250, 120, 2))
    assert found > 500 and kept >= 0.9 * found


def test_no_link_is_lost_among_texts_just_below_the_threshold(make, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", 60)  # buckets in several parts
    found, kept = kept_links(make, changed(250, 120, 2))
    assert kept == found > 500


def test_rows_that_share_an_id_or_have_none_are_compared(spark, make):
    one, two, three = (" ".join(f"{c}{k}" for k in range(40)) for c in "abc")
    rows = [(1, one), (1, two), (1, one), (2, two), (3, three), (None, three), (None, one + " z"), (None, "alone here"), (None, "alone here"), (None, None), (None, None), (4, "")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], make(["x"]).schema).repartition(3)
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert kept == Counter([(1, one), (1, two), (3, three), (None, "alone here"), (None, None), (None, None), (4, "")])
    assert {r.doc_id: r.class_id for r in neardup.classes(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 50)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    alone = {x for x in root if all(u == v for u, v in edges if x in (u, v))}
    assert got == {x: r for x, r in root.items() if x not in alone}


def bm25(texts, query, k=10):
    bags = {i: Counter(words(t)) for i, t in texts.items()}
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
    df = Counter(w for b in bags.values() for w in b)
    out = []
    for i, b in bags.items():
        n = sum(b.values())
        s = sum(c * math.log1p((len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * n / mean)) for w, c in Counter(words(query)).items() if w in b)
        if s > 0:
            out.append((-s, i))
    return sorted(out)[:k]


def test_search_is_brute_force(spark, docs, small, monkeypatch):
    monkeypatch.setattr(search, "SHARD_WORDS", 5000)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = defaultdict(list)
    for r in sorted(op9_search(spark, small).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.doc_id, r.score))
    for q in [i for i in texts if i % 100 == 0]:
        want = bm25(texts, texts[q])
        assert len(got[q]) == len(want)
        assert all(abs(s + w) < 1e-6 * max(1, s) for (_, s), (w, _) in zip(got[q], want))


def test_search_edges(make, odd):
    texts = dict(enumerate(odd + ["tie one", "tie one", "tie two"]))
    df = make(list(texts.values()), score=1)
    rows = search.search(df, df.where("doc_id >= 15 or doc_id < 3"), k=2, block_queries=2).collect()
    for q in (15, 16, 17):
        assert [r.doc_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == q] == [i for _, i in bm25(texts, texts[q], 2)]
    assert not [r for r in rows if r.query_id < 3]


def test_repeated_query_rows_have_lists_of_their_own(make):
    df = make([f"word x{i}" for i in range(8)])
    ask = df.where("doc_id = 3")
    rows = search.search(df, ask.unionByName(ask), k=5, block_queries=1).collect()
    want = [(1, 3), (2, 0), (3, 1), (4, 2), (5, 4)]
    assert sorted((r["rank"], r.doc_id) for r in rows) == sorted(want + want)


PAGE = """<html><head><title>t</title></head><body><nav><a>Home</a></nav><div class="box">Site of all</div><!-- x > y --><article><h1>A &amp; B {n}</h1>
<p>One<br>two&nbsp; three <b>bold<p>Same line everywhere<ul><li>x<li>y</ul><div class="share">Share</div><div>Teaser of all</div><script>if (a<b) "</p>"</script></article>
<div class="comments"><p>Nice!</p></div><footer>&copy;</footer></body></html>"""


def test_page_text(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.replace("{n}", str(i))) for i in range(5)]
    rows += [(10, None, None), (11, "http://other.example/", ""), (12, "http://other.example/a", "<p>only &lt;one&gt;<div class=ad>buy</div> 1 < 2"), (13, "http://other.example/b", "<p>cut <b attr='"),
             (0, "http://h.example/0", PAGE.replace("{n}", "0"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r.page_id, r.text) for r in pagetext.extracted(df).collect()]
    assert len(got) == len(rows)
    texts = dict(got)
    assert texts[3] == "A & B 3\n\nOne two three bold\n\nSame line everywhere\n\nx\n\ny"
    assert texts[10] == "" and texts[11] == "" and texts[12] == "only <one>\n\n1 < 2" and texts[13].startswith("cut")
    assert pagetext.extracted(df.where("false")).count() == 0


def test_pipeline(spark, docs, small):
    out = corpus_pipeline.run(spark, small)
    kept = {r.doc_id: r for r in out.collect()}
    source = {r.doc_id: r for r in docs.collect()}
    assert out.columns == ["doc_id", "ids", "decoded"] and 0 < len(kept) < len(source)
    assert not any(re.search(r"[a-z]@[a-z0-9-]+\.[a-z]", r.decoded) for r in kept.values())
    whole = [" ".join(words(source[i].text)) for i in kept if words(source[i].text)]
    assert len(set(whole)) == len(whole)  # no exact copies left
    again = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        again = stage(spark, again, small)
        assert again.columns == docs.columns


def test_stages_take_any_extra_columns(spark, docs, small):
    """Columns named like those of the operators pass through every stage, and an empty table through all."""
    from pyspark.sql import functions as F

    names = ["score", "predicted", "ratio", "items", "n_hit", "n_words", "contaminated", "key", "class", "lead", "root", "spans", "ids", "decoded", "bytes", "__key"]
    extra = docs.limit(60).withColumns({n: F.lit(n) for n in names})
    for table in (extra, extra.where("false")):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, small)
            assert now.columns == table.columns, name
            rows = now.collect()
            assert all(r[n] == n for r in rows for n in names)
            now = spark.createDataFrame(rows, table.schema)
        out = corpus_pipeline.STAGES[-1][1](spark, now, small)
        assert out.count() == now.count()
    assert now.count() == 0


# ---- page text: marks and counting ------------------------------------------------------------
ARTICLE = "<article><h1>T</h1><p>body text one.</p><p>body two &amp; three.</p></article>"
BODY = "T\n\nbody text one.\n\nbody two & three."


@pytest.mark.parametrize("source, want", [
    ('<div class="content with-sidebar">' + ARTICLE + '<div class="sidebar">x</div></div>', BODY),
    (ARTICLE.replace("<article>", '<article class="post ad-free">'), BODY),
    (ARTICLE.replace("article", "main").replace("<main>", '<main class="search-results">'), BODY),
    ('<div id="main-menu-page"><nav>n</nav><p>body text one.</p><p>more text here</p></div><div class="footer">f</div>', "body text one.\n\nmore text here"),
    ('<section class="social-history"><h1>T</h1><p>long body text one.</p></section><div class="ad">buy</div>', "T\n\nlong body text one."),
    (ARTICLE + '<section class="comments"><article class="comment"><p>nice post</p></article></section>', BODY),
    ('<div class="page">' + ARTICLE + '</div><div class="ads">zz</div>', BODY),
    ('<header>H</header><div class="menu">a</div><p>one two three</p><div class="share">s</div>', "one two three"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
])
def test_marks_never_take_the_article(source, want):
    assert pagetext.Page(source).text(set()) == want


def test_recurring_blocks_are_counted_over_different_pages(spark):
    """Without any telling tag or class: copies of a page keep their text, templates go, also rotating ones of a large host."""
    bare = lambda i, more="": f"<div>menu of the site</div><p>text of page {i}, all its own.</p>{more}"
    rows = [(i, "http://copies.example/x", bare(7)) for i in range(4)] + [(10 + i, "http://copies.example/y", bare(100 + i)) for i in range(2)]
    rows += [(100 + i, f"http://site.example/{i}", bare(i)) for i in range(6)]
    rows += [(1000 + i, f"http://big.example/{i}", bare(i, f"<div>teaser {i % 20}</div>")) for i in range(2000)]
    rows += [(9000 + i, None, bare(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "key": F.lit(2), "host": F.lit(3), "template": F.lit(None), "hashes": F.lit(0)})
    got = {r.page_id: r.text for r in pagetext.extracted(df.repartition(5)).collect()}
    assert len(got) == len(rows)
    assert all(f"text of page {7}, all its own." in got[i] for i in range(4))  # three contents are not yet counted against one that stands four times
    assert all(got[100 + i] == f"text of page {i}, all its own." for i in range(6))
    assert all(got[1000 + i] == f"text of page {i}, all its own." for i in range(2000))
    assert all(got[9000 + i] == f"menu of the site\n\ntext of page {i}, all its own." for i in range(9))  # no url, no host


def test_search_adds_up_frequent_terms_and_keeps_ties_in_order(make, monkeypatch):
    """Copies tie exactly wherever they stand in a shard, with terms in matrix rows, in postings, and in both."""
    rng = random.Random(6)
    texts = [" ".join(rng.choices([f"w{i * i // 40}" for i in range(60)], k=rng.randint(1, 60))) for _ in range(150)]
    texts += texts[:70] + ["", "only here"] + texts[:40]
    want = {i: [d for _, d in bm25(dict(enumerate(texts)), texts[i], 7)] for i in range(0, len(texts), 9)}
    df = make(texts).coalesce(1)
    rows_by = []
    for dense in (0, 3, 1000):
        monkeypatch.setattr(search, "DENSE", dense)
        got = defaultdict(list)
        for r in sorted(search.search(df, df.where("doc_id % 9 = 0"), k=7).collect(), key=lambda r: r["rank"]):
            got[r.query_id].append((r.doc_id, r.score))
        rows_by.append(dict(got))
        for i, best in want.items():
            assert [round(s, 9) for _, s in got[i]] == [round(-s, 9) for s, _ in bm25(dict(enumerate(texts)), texts[i], 7)]
            assert len({d for d, _ in got[i]}) == len(best)
            for (a, s), (b, t) in zip(got[i], got[i][1:]):
                assert s > t or (s == t and a < b)
    assert rows_by[0] == rows_by[1] == rows_by[2]


def test_search_scores_few_documents_exactly(monkeypatch):
    """Documents that cannot be among the best are left out by the sums of frequent terms alone."""
    import pyarrow as pa

    rng = random.Random(7)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(40)], k=50)) for _ in range(1000)]
    q = search.Queries([(0, texts[0])])
    h, first = search.terms(pa.array(texts))
    hit, t = q.known(h)
    q.idf, q.mean = np.ones(len(q.terms)), 50.0
    shard = search.Shard(q, list(range(1000)), t, np.repeat(np.arange(1000), np.diff(first))[hit], np.diff(first))
    seen, exact = [], search.Shard.exact
    monkeypatch.setattr(search.Shard, "exact", lambda self, docs, *a: seen.extend(docs) or exact(self, docs, *a))
    (part, sums), = shard.sums(q.parts)
    d, s, floor = shard.best(part, sums, 10, 0.0)
    everything = exact(shard, np.arange(1000), *part)
    assert set(np.flatnonzero(everything >= np.sort(everything)[-10])) == set(d) and floor == np.sort(everything)[-10]
    assert len(seen) < 20


def test_search_reads_documents_once_for_all_blocks(make, monkeypatch):
    """More blocks of queries are no more passes over the documents, and no other rows."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices([f"w{i * i // 40}" for i in range(60)], k=rng.randint(0, 40))) for _ in range(120)]
    df = make(texts)
    ask = df.where("doc_id % 10 = 0")
    passes, settled = [], search.settled
    monkeypatch.setattr(search, "settled", lambda rows: passes.append(1) or settled(rows))
    many = search.search(df, ask, k=5, block_queries=2)
    assert len(passes) == 1
    assert sorted(many.collect()) == sorted(search.search(df, ask, k=5).collect())


@pytest.mark.parametrize("first,dense,middle,wide", [(16, 500, 500, 64), (1, 2, 3, 8), (3, 0, 0, 4), (1 << 40, 500, 0, 64)])
def test_search_by_groups_floors_and_wide_blocks(make, monkeypatch, first, dense, middle, wide):
    """Rows are those of brute force, however documents are grouped and wherever floors come from."""
    for name, value in (("FIRST", first), ("DENSE", dense), ("MIDDLE", middle), ("WIDE", wide), ("GROUPED", 50), ("ENTRIES", 64), ("TOGETHER", 3)):
        monkeypatch.setattr(search, name, value)
    rng = random.Random(9)
    tongues = [[f"{a}{int(rng.paretovariate(0.4)) % 400}" for _ in range(300)] + ["on", "la"] * 9 for a in "abc"]
    texts = [" ".join(rng.choices(rng.choice(tongues), k=int(rng.paretovariate(0.8)) % 90 + 1)) for _ in range(400)]
    texts += texts[:20] + ["", None, "b7 " * 60, "nowhere else"]
    df = make(texts).coalesce(2)
    got = defaultdict(list)
    for r in sorted(search.search(df, df.where("doc_id % 11 = 0 or doc_id > 418"), k=6).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.doc_id, r.score))
    bags = {i: t or "" for i, t in enumerate(texts)}
    for i in (i for i in bags if i % 11 == 0 or i > 418):
        want = bm25(bags, bags[i], 6)
        assert [round(s, 8) for _, s in got[i]] == [round(-s, 8) for s, _ in want]
        for (a, s), (b, t) in zip(got[i], got[i][1:]):
            assert s > t or (s == t and a < b)


def test_shard_leaves_out_what_cannot_reach_a_known_floor():
    """A query whose words stand here in different places only meets no document of the shard once its floor is known."""
    texts = [f"common c{i} d{i}" for i in range(256)]
    q = search.Queries([(0, " ".join(f"c{i}" for i in range(0, 256, 64))), (1, texts[7])])
    q.idf, q.mean = np.ones(len(q.terms)), 3.0
    h, first = search.terms(pa.array(texts))
    hit, t = q.known(h)
    shard = search.Shard(q, list(range(256)), t, np.repeat(np.arange(256), np.diff(first))[hit], np.diff(first))
    (_, none), (part, some) = shard.sums(q.parts, 1, np.array([1.5, 2.9]))
    assert not len(none[0]) and 7 in some[0] and len(some[0]) <= search.BLOCK
    assert shard.best(part, some, 1, 2.9)[0].tolist() == [7]
