"""Chat formatting, url filter, page differencing and license scan."""

import hashlib
import math
import random
import re

import duckdb
import pytest
from llm_data import EDGES, SF
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from acqlens.llm import chat, licenses, pages, queries, urls

TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    con.execute(f"CREATE VIEW q AS {queries.SQL[name]}")  # as the checking tool does
    want = con.execute("SELECT * FROM q")
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    key = lambda rows: sorted(map(repr, rows))
    assert key(tuple(r[c] for c in columns) for r in got.collect()) == key(want.fetchall())


def test_every_query_is_registered():
    names = list(__spark_entry__.queries())
    assert [n for n in names if n.startswith("op")] == list(queries.QUERIES) and "pipeline" in names


# chat

def test_escape_is_reversible_and_leaves_no_control_string():
    rng = random.Random(1)
    parts = [*chat.CONTROLS, "<|end|>", "<|turn|>", "\\", "\\\\", "<", "|", "[", "/", "s>", "é", "x"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(9)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROLS)


def test_adjacent_text_parts_spell_no_control_string():
    rng = random.Random(2)
    for _ in range(2000):
        texts = ["".join(rng.choice("<|/sS>[]INT\\YeB ") for _ in range(rng.randrange(5))) for _ in range(3)]
        visitor = chat.format_turn("assistant", [{"kind": "text", "text": t} for t in texts])
        (role, body), = chat._TURN.findall(visitor.out)
        assert role == "assistant" and chat.unescape(body) == "".join(texts)
        assert [chat.unescape(visitor.out[a:b]) for a, b in visitor.loss] == texts


def test_parts_become_ordered_placeholders(spark):
    parts = ("array(named_struct('kind','image','text',null,'ref','a.png','width',57,'height',28,'seconds',null,'pages',null),"
             "named_struct('kind','text','text','see <|image:1|>','ref',null,'width',null,'height',null,'seconds',null,'pages',null),"
             "named_struct('kind','audio','text',null,'ref','b.wav','width',null,'height',null,'seconds',2.02D,'pages',null),"
             "named_struct('kind','document','text',null,'ref','c.pdf','width',null,'height',null,'seconds',null,'pages',3))")
    turns = spark.range(1).select(F.lit(7).alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), F.expr(parts).alias("parts"))
    formatted = chat.format_turns(turns)
    row = formatted.first()
    assert row.formatted == "<|turn|>assistant<|says|><|image:1|>see <\\|image:1|><|audio:2|><|document:3|><|end|>"
    assert [(a.ordinal, a.kind, a.ref, a.tokens) for a in row.attachments] == [(1, "image", "a.png", 3), (2, "audio", "b.wav", 51), (3, "document", "c.pdf", 1536)]
    assert [row.formatted[a.at :].startswith(f"<|{a.kind}:{a.ordinal}|>") for a in row.attachments] == [True] * 3
    back = chat.read_back(formatted).first()
    assert back.loss_chars == len("see <|image:1|>") and back.n_attachments == 3 and back.attachment_tokens == 3 + 51 + 1536
    assert back.turns_sha256 == hashlib.sha256(b"assistant\nsee <|image:1|>\n").hexdigest()


def test_chat_edge_cases(spark):
    rows = [(1, 0, "user", None), (1, None, None, "x"), (1, 0, "user", None), (None, 3, "assistant", "é\n"), (2, 1, "assistant", "z" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("parts", chat.text_part(F.col("text"))).withColumn("conv", F.lit("x"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"\nx\nuser\n\nuser\n\n").hexdigest() and got[1].n_turns == 3 and got[1].loss_chars == 0
    assert got[None].loss_sha256 == hashlib.sha256("é\n".encode()).hexdigest() and got[2].loss_chars == 200_000
    assert chat.read_back(chat.format_turns(df.limit(0))).collect() == []


# urls

def test_url_rules_and_propagation(spark):
    rules = [("allow", "good.org/"), ("block", "bad.net/"), ("allow", "bad.net/fine/")]
    html = lambda *hosts: "".join(f'<a href="http://{h}/x">l</a>' for h in hosts) + '<a HREF=/local>r</a>'
    rows = [(1, "http://www.good.org/a?b", html("friend.com")), (2, "https://BAD.net/x", html()), (3, "http://bad.net/fine/1", None),
            (4, "http://shady.com/", html("bad.net", "bad.net", "www.bad.net")), (5, "http://friend.com/p#q", html("shady.com", "a.org")),
            (6, None, html("bad.net")), (7, "no scheme", None), (8, "http://notgood.org/", None), (None, "http://good.org", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("x"))
    got = {r.page_id: r for r in urls.judged(df, rules).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("www.good.org", "/a", "good.org/", "allow")
    assert (got[2].rule, got[2].verdict, got[3].rule, got[3].verdict) == ("bad.net/", "block", "bad.net/fine/", "allow")
    assert (got[4].rule, got[4].verdict) == (None, "block")  # links to a blocked host
    assert got[5].verdict == "allow" and got[5].trust > got[5].distrust > 0
    assert (got[6].host, got[6].path, got[6].verdict, got[7].host) == ("", "", "allow", "")
    assert got[8].rule is None and (got[None].path, got[None].rule) == ("", None)  # an empty path does not start with /
    assert urls.judged(df.limit(0), rules).collect() == []


def test_propagation_equals_power_iteration(spark):
    rng = random.Random(3)
    edges = {(f"h{a}", f"h{b}"): rng.randrange(1, 5) for a, b in ((rng.randrange(12), rng.randrange(12)) for _ in range(40)) if a != b}
    seeds = {"h0": (3.0, 0.0), "h5": (1.0, 2.0), "h9": (0.0, 4.0)}
    frame = spark.createDataFrame([(*k, n) for k, n in edges.items()], "src string, dst string, n bigint")
    got = {r.host: (r.trust, r.distrust) for r in urls.propagate(frame, spark.createDataFrame(
        [(h, *s) for h, s in seeds.items()], "host string, trusted double, distrusted double")).collect()}
    for walk in (0, 1):
        way = {(k if walk == 0 else k[::-1]): n for k, n in edges.items()}
        out = {h: sum(n for (s, _), n in way.items() if s == h) for h, _ in way}
        start = {h: s[walk] for h, s in seeds.items()}
        rank = dict(start)
        for _ in range(300):
            new = {h: (1 - urls.DAMPING) * m for h, m in start.items()}
            for (s, d), n in way.items():
                new[d] = new.get(d, 0) + urls.DAMPING * rank.get(s, 0) * n / out[s]
            rank = new
        for h, m in rank.items():
            assert got.get(h, (0.0, 0.0))[walk] == pytest.approx(m, rel=1e-6)


def rows_of(spark, sql, **tables):
    """The rows of an oracle statement over these DataFrames."""
    import duckdb

    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    found = con.sql(sql)
    return found.columns, sorted(found.fetchall(), key=repr)


def test_query_and_sql_agree_on_chains_of_hosts(spark, tmp_path):
    chain = ["a.org", *(f"c{i}.com" for i in range(30)), "x.example.org"]
    rows = [(i, f"http://{src}/es/", f'<a href="http://{dst}/">x</a> <a href="//c{i * 7 % 30}.com/">y</a>' if i % 5 == 4 else f'<a href="http://{dst}/">x</a>')
            for i, (src, dst) in enumerate(zip(chain, chain[1:]))] + [(99, f"http://{chain[-1]}/es/", None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    columns, want = rows_of(spark, queries.SQL["op2_url_filter"], pages=df)
    got = queries.op2_url_filter(spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == want and {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_query_and_sql_agree_on_rows_of_one_turn(spark, tmp_path):
    said = ["yes", "yes please", "", "!", "<|", "<z", "\\", "a\\b", "a", None, "<|end|>", "<\\|end|>", "é"]
    rows = [(c, t, r, x) for c in (1, 2) for t in (0, 1) for r in ("user", "assistant", None, "user!") for x in said[:: c]]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    columns, want = rows_of(spark, queries.SQL["op1_chat_formatting"], conversations=df)
    got = queries.op1_chat_formatting(spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == want


def test_long_chains_reach_the_converged_ranks(spark):
    chain = [f"c{i}.com" for i in range(20)]  # c9 is 9 hops from the allowed host and 10 from the blocked one
    far = [f"f{i}.com" for i in range(26)]  # no trust; f0 is 25 hops from the blocked host
    ring = [("r0.com", "r1.com"), ("r1.com", "r2.com"), ("r2.com", "r0.com")]
    links = [*zip(chain, chain[1:]), *zip(far, far[1:]), *ring]
    rows = [(i, f"http://{src}/", f'<a href="http://{dst}/">x</a>') for i, (src, dst) in enumerate(links)]
    rows += [(100, f"http://{chain[-1]}/", None), (101, f"http://{far[-1]}/", None)]
    rules = [("allow", "c0.com/"), ("block", "c19.com/"), ("block", "f25.com/"), ("allow", "r0.com/")]
    got = {r.host: r for r in urls.judged(spark.createDataFrame(rows, "page_id bigint, url string, html string"), rules).collect()}
    d = urls.DAMPING
    for i, host in enumerate(chain):
        assert got[host].trust == pytest.approx((1 - d) * d**i) and got[host].distrust == pytest.approx((1 - d) * d ** (19 - i))
    assert got["c9.com"].verdict == "allow" and got["c10.com"].verdict == "block"
    for i, host in enumerate(far):
        assert got[host].distrust == pytest.approx((1 - d) * d ** (25 - i)) and got[host].verdict == "block"
    for i in range(3):
        assert got[f"r{i}.com"].trust == pytest.approx((1 - d) * d**i / (1 - d**3), rel=1e-7)


# pages

def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(7)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        places = pages.aligned(a, b)
        rest = iter(b)
        assert len(places) == lcs(a, b) and all(any(a[i] == y for y in rest) for i in sorted(places))


def test_article_text(spark):
    html = ('<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li>Home</ul></nav>'
            '<div class="cookie-notice">We use cookies</div><article><h1>A &amp;amp; B</h1><p><b>One  \n two<br>three<p>caf&eacute; &lt;x&gt;'
            '<script>var t="</p>";</script><div class="ad">Buy</div><ul><li>i<li>j</ul><section id="comments"><p>First!</p></section></article>'
            '<aside>Side</aside><form>Search</form><footer>&copy; me</footer></body></html>')
    rows = [(1, "http://a.com/1", html), (2, "http://a.com/2", None), (3, None, "<p>alone"), (4, "http://b.com/x/1", "<div>Site menu</div><p>first body</p><div>Imprint</div>"),
            (5, "http://b.com/x/2", "<div>Site menu</div><p>second body</p><div>Imprint</div>"), (5, "http://b.com/x/2", "<p>" + "w " * 100_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("q")).coalesce(1)
    got = sorted((r.page_id, r.text) for r in pages.extract(df).collect())
    assert got[0] == (1, "A &amp; B\nOne two three\ncafé <x>\ni\nj") and got[1] == (2, "") and got[2] == (3, "alone")
    assert got[3][1] == "first body" or "first body" in got[3][1]
    assert len(got) == 6 and len(got[5][1]) in (199_999, len("Site menu\nsecond body\nImprint"), len("second body"))
    assert pages.extract(df.limit(0)).collect() == []


def test_shared_lines_go_and_articles_stay():
    page = [("menu", pages.PLAIN), ("body", pages.PLAIN), ("foot", pages.PLAIN)]
    other = [("menu", pages.PLAIN), ("else", pages.PLAIN), ("foot", pages.PLAIN)]
    assert pages.main_lines(page, other) == ["body"] and pages.main_lines(page, None) == ["menu", "body", "foot"]
    article = [("menu", pages.PLAIN), ("body", pages.ARTICLE)]
    assert pages.main_lines(article, article) == ["body"]


def test_copies_without_an_article_are_no_partners(spark):
    html = lambda body: f"<div>Site menu</div><p>{body}</p><div>Imprint</div>"
    rows = [(1, "http://a.com/x/1", html("first")), (1, "http://a.com/x/1", html("first")), (2, "http://a.com/x/1?p", html("first")),
            (3, "http://a.com/x/2", html("second")), (4, "http://a.com/x/2/print", html("second").replace("p>", "section>")),
            (5, "http://b.com/1", html("only")), (6, "http://b.com/2", html("only")), (7, None, html("none")), (8, None, html("none"))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    got = sorted((r.page_id, r.text) for r in pages.extract(df.repartition(1)).collect())
    whole = "Site menu\n{}\nImprint".format
    assert got == [(1, "first"), (1, "first"), (2, "first"), (3, "second"), (4, "second"),
                   (5, whole("only")), (6, whole("only")), (7, whole("none")), (8, whole("none"))]


def brute_pages(rows):
    """Every page's text, page by page: its partner by a search in the sorted pages of its host, alignment by table."""
    parsed = [(u, *((lambda m: (m[1].lower(), m[2]))(re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "://")) if u and "://" in u else ("", "")),
               pages.lines_of(h), i) for i, u, h in rows]
    order = sorted(range(len(rows)), key=lambda k: (parsed[k][1], parsed[k][2], rows[k][0]))
    out = []
    for place, k in enumerate(order):
        url, host, path, lines, page = parsed[k]
        words = [x for x, _ in lines]
        near = []
        for side in (order[:place][::-1], order[place + 1 :]):
            for other in side:
                if parsed[other][1] != host or not host:
                    break
                if [x for x, _ in parsed[other][3]] != words:
                    near.append(parsed[other])
                    break
        common = lambda o: next((n for n, (a, b) in enumerate(zip(o[2], path)) if a != b), min(len(o[2]), len(path)))
        best = max(near, key=common, default=None)
        shared = set()
        if best is not None:
            b = [x for x, _ in best[3]]
            table = [[0] * (len(b) + 1) for _ in range(len(words) + 1)]
            for i, x in enumerate(words):
                for j, y in enumerate(b):
                    table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
            i, j = len(words), len(b)
            while i and j:
                if table[i][j] == table[i][j - 1]:
                    j -= 1
                elif table[i][j] == table[i - 1][j]:
                    i -= 1
                else:
                    shared.add(i - 1)
                    i, j = i - 1, j - 1
        article = any(p in (pages.ARTICLE, pages.NAMED_ARTICLE) for _, p in lines)
        text = [x for i, (x, p) in enumerate(lines) if p == pages.ARTICLE or (p == pages.NAMED_ARTICLE and i not in shared) or (
            not article and i not in shared and (p == pages.PLAIN or (p == pages.NAMED_PLAIN and best is not None)))]
        out.append((page, "\n".join(text)))
    return sorted(out)


def test_whole_query_equals_brute_force(spark, tmp_path):
    """Sites with and without article elements, with notices inside articles, copies, repeated lines and pages without a host."""
    rng = random.Random(12)
    menus = {h: [f"{h} menu {k}" for k in range(3)] + [f"a longer line that {h} repeats on every page"] for h in "abcd"}
    rows = []
    for k in range(160):
        h = rng.choice("abcd")
        body = [f"paragraph {rng.randrange(60)} of the site" for _ in range(rng.randrange(5))]
        inner = "".join(f"<p>{x}</p>" for x in body) + rng.choice(["", f'<div class="notice">{h} is moving</div>', f'<div class="site-notice">only {k}</div>'])
        frame = "".join(f"<div>{x}</div>" for x in menus[h])
        html = frame + (f"<article>{inner}</article>" if h in "ab" else f"<section>{inner}</section>") + '<div class="ad">buy</div><footer>f</footer>' + frame
        rows.append((k, rng.choice([f"http://{h}.com/{rng.randrange(4)}/{k}", f"http://{h}.com/{rng.randrange(4)}", None, "no url"]) if k % 9 == 0
                     else f"http://{h}.com/{rng.randrange(4)}/{k}", html))
    rows += [(200 + k, f"http://{h}.com/copy/{k}", rows[0][2]) for k in range(12) for h in "a"]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5).write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op9_page_differencing(spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.text) for r in got) == brute_pages(rows)
    notices = [r.text for r in got if "is moving" in r.text]
    assert all(r.n_chars == len(r.text) for r in got) and len(notices) < sum("is moving" in h for *_, h in rows)


def test_class_names_alone_delete_nothing_in_articles():
    for html, text in (('<article><section class="related-work">Others did</section></article>', "Others did"),
                       ('<article><p>a <b class="notice">bold</b> word</article>', "a bold word"),
                       ('<article><p class="notice-period">Three months</p></article>', "Three months"),
                       ('<article>x\x00y</article>', "x\ufffdy")):
        assert pages.main_lines(pages.lines_of(html), None) == [text]
    page, other = (pages.lines_of(f'<article><p>{x}</p><div class="banner">Sale</div></article>') for x in "ab")
    assert pages.main_lines(page, other) == ["a"]


def test_partners_do_not_depend_on_partitions(spark):
    html = lambda body: f"<div>Site menu</div><p>{body}</p><div>Imprint</div>"
    rows = [(i, f"http://{h}.com/{i // 3}/{i}", html(f"{h} {i // 4}")) for h in "abc" for i in range(24)]
    rows += [(90, "http://d.com/1", html("alone")), *((91, "http://e.com/1", html("copy")) for _ in range(20)), (92, "http://e.com/2", html("last"))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    want = sorted((i, u, t.removeprefix("<div>Site menu</div><p>").split("<")[0] if i != 90 else "Site menu\nalone\nImprint") for i, u, t in rows)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for partitions in (1, 5, 60):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            assert sorted(tuple(r) for r in pages.extract(df).collect()) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# licenses

def brute_base(text):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w))
              if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))


NOTICES = [(901, "x " * 300 + licenses.TEMPLATES[0][1].replace("charge", "any charge").replace("modify", "alter") + " y" * 40),
           (902, "Released under\nthe MIT-License. mit license MIT license"), (903, licenses.TEMPLATES[9][1][:25]),
           (904, "Licensed under CC BY-NC 4.0."), (905, "mit"), (906, "general public license " * 2000)]


def test_license_scan(documents, make_docs):
    docs = documents.union(make_docs([*EDGES, *NOTICES]))
    rows = licenses.scan(docs).collect()
    have = sorted((r.n_words, r.n_base, repr(r.first_word), repr(r.last_word), r.base_labels) for r in rows)
    want = sorted((a, b, repr(c), repr(d), e) for a, b, c, d, e in (brute_base(r.text) for r in docs.collect()))
    assert have == want
    got = {r.doc_id: r for r in rows if r.doc_id is not None and r.doc_id > 900}
    assert got[901].labels == "mit" and got[901].n_base == 0 and 0.6 <= got[901].score < 1
    assert got[902].labels == "mit" and got[903].labels == "" and got[904].labels == "cc-by-nc" and got[904].score == 1.0
    assert got[906].n_base == 2000 and got[906].last_word == 5997
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)


def test_notices_with_inserted_words_keep_their_label(make_docs):
    notice = licenses.TEMPLATES[0][1].split()
    filler = [f"word{i}" for i in range(20)]
    rows = [(n * 1000 + at, " ".join(["before", *notice[:at], *filler[:n], *notice[at:], "after"])) for n in range(0, 21, 4) for at in range(3, len(notice), 6)]
    rows += [(90_000, " ".join([*notice, *filler, *notice])), (90_001, " ".join([*notice[:25], *filler * 10, *notice[25:]])),
             (90_002, " ".join([*notice[25:], *notice[:25]])), (90_003, " ".join(notice[:20]))]
    got = {r.doc_id: r for r in licenses.scan(make_docs(rows)).collect()}
    assert all(r.labels == "mit" and 0.9 <= r.score <= 1 for i, r in got.items() if i <= 90_000)
    assert got[90_001].labels == got[90_002].labels == got[90_003].labels == ""


def test_added_labels_and_scores_equal_brute_force(make_docs):
    """Spans found plainly: grams placed by diagonal, near diagonals merged, pieces chained in order, then verified."""
    rng = random.Random(31)
    split = lambda t: [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)})) if x]
    templates = [(label, split(t)) for label, t in licenses.TEMPLATES]
    rows = []
    for k in range(120):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            _, words = rng.choice(templates)
            words = [w for w in words if rng.random() > rng.choice([0, 0.02, 0.1])]
            at, n = rng.randrange(len(words)), rng.choice([0, 1, 5, 25])
            parts += [*words[:at], *(f"z{rng.randrange(99)}" for _ in range(n)), *words[at:], *(f"z{rng.randrange(99)}" for _ in range(rng.randrange(30)))]
        rows.append((k, " ".join(parts)))

    def brute(text):
        words, found, best = split(text), set(), 0.0
        for label, template in templates:
            n = len(template) - 2
            place = {}
            for t in range(n):
                place.setdefault(tuple(template[t : t + 3]), []).append(t)
            votes = {}
            for p in range(len(words) - 2):
                for t in place.get(tuple(words[p : p + 3]), []):
                    votes.setdefault(p - t, []).append((p, t))
            pieces, last = [], None
            for d in sorted(votes):
                if last is None or d - last > licenses.DRIFT:
                    pieces.append([])
                pieces[-1] += votes[d]
                last = d
            whole = [(min(p for p, _ in x), max(p for p, _ in x) + 3, {t for _, t in x}) for x in pieces]
            slack = math.ceil((licenses.STRETCH - 1) * (n + 2)) + licenses.DRIFT
            chains, before = [], None
            for piece in sorted((x for x in whole if len(x[2]) >= licenses.LEAST_VOTES), key=lambda x: x[:2]):
                if before is None or min(piece[2]) < max(before[2]) or piece[0] - before[1] > slack:
                    chains.append(piece)
                else:
                    chains[-1] = (min(chains[-1][0], piece[0]), max(chains[-1][1], piece[1]), chains[-1][2] | piece[2])
                before = piece
            for start, end, places in whole + chains:
                if len(places) / n >= licenses.COVERAGE and end - start <= licenses.STRETCH * (n + 2) + licenses.DRIFT:
                    found.add(label)
                    best = max(best, len(places) / n)
        return found, best

    for r, (_, text) in zip(sorted(licenses.scan(make_docs(rows)).collect(), key=lambda r: r.doc_id), rows, strict=True):
        found, best = brute(text)
        assert set(filter(None, r.labels.split(","))) == found | set(filter(None, r.base_labels.split(",")))
        assert r.score == pytest.approx(1.0 if r.n_base else best)


def test_license_edge_tables(edges, make_docs):
    assert licenses.scan(make_docs([])).collect() == [] and licenses.scan(edges).count() == len(EDGES)


# pipeline

def test_pipeline_equals_its_operators_by_brute_force(spark):
    """Each stage's decision is recomputed plainly on the stage's own input."""
    from test_near_duplicates import brute_join, brute_leaks
    from test_packing_and_scoring import BPE

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        after = {r.doc_id: r.text for r in out.collect()}
        if name == "quality_rules":
            kept = {r.doc_id for r in queries.op4_quality_rules(spark, SF).where("kept").collect()}
        elif name == "ngram_jaccard_join":
            kept = {int(doc) for doc, low, _ in brute_join(before) if doc == low}
        elif name == "benchmark_decontamination":
            kept = {i for i, _ in before} - {i for i, _ in brute_leaks(before, items)}
        else:
            kept = set(after)
            assert all(("[secret]" in after[i]) == bool(after[i] != t) for i, t in before)
        assert set(after) == kept
        path = f"{spark.sparkContext.getCheckpointDir()}/test-{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    pieces = corpus_pipeline.run(spark, SF).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in pieces} == set(texts)
    for doc, text in texts.items():
        own = sorted((r for r in pieces if r.doc_id == doc), key=lambda r: r.start)
        assert [i for r in own for i in r.ids] == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_edge_tables(spark, make_docs, edges, name, stage):
    assert stage(spark, make_docs([]), SF).collect() == []
    out = stage(spark, edges, SF)
    if name != "packing":
        assert out.columns == edges.columns
        out.write.format("noop").mode("overwrite").save()
    if name in ("secret_scan", "benchmark_decontamination", "packing"):
        assert out.count() >= len(EDGES)
