import itertools
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from coppice.llm import blocks, lines, neardup, packing, residue, scans, splitting, subjects, tokenizer

REC = "record_id bigint, url string, text string, line_no string"


# ---- lines repeated within a site


def brute_repeated(rows, least=5):
    norm = lambda l: re.sub("[0-9]+", "0", " ".join(l.split()).lower())
    host = lambda u: re.sub(r"^www\.", "", re.sub(r":\d*$", "", re.sub(r"^.*@", "", (re.match(r"^[A-Za-z][\w+.-]*://([^/?#]*)", u or "") or [None, ""])[1])).lower())
    urls = {}
    for _, u, t, _ in rows:
        for l in (t or "").split("\n"):
            urls.setdefault((host(u), norm(l)), set()).add(u)
    return {(r, i) for r, u, t, _ in rows if host(u) for i, l in enumerate((t or "").split("\n"), 1) if norm(l) and len(urls[host(u), norm(l)]) >= least}


def test_repeated_lines(spark):
    r = random.Random(2)
    pool = ["Menu", "  menu ", "Page 1 of 9", "PAGE 22 OF 3", "© 2024", "", "text one", "text two", "Ｍ", "a b", "A  B"]
    sites = ["https://www.A.example/", "http://a.example:80/", "https://u@b.example/", "nonsense", "HTTPS://A.EXAMPLE/"]
    rows = [(i, r.choice(sites) + str(r.randint(1, 9)), "\n".join(r.choice(pool) for _ in range(r.randint(0, 8))), "clash") for i in range(120)]
    rows += [rows[0], (900, None, "Menu", "x"), (901, "https://a.example/q", None, "x"), (902, "https://a.example/r", "", "x"), (903, "https://a.example/long", "word " * 30000 + "\nMenu", "x")]
    df = spark.createDataFrame(rows, REC)
    got = lines.repeated_lines(df).collect()
    assert len(got) == len({(x.record_id, x.line_no) for x in got}) and {(x.record_id, x.line_no) for x in got} == brute_repeated(rows)
    clean = {x.record_id: x for x in lines.without_repeated_lines(df).collect()}
    gone = brute_repeated(rows)
    for i, _, t, _ in rows:
        want = None if t is None else "\n".join(l for n, l in enumerate(t.split("\n"), 1) if (i, n) not in gone)
        assert clean[i].text == want
    assert lines.repeated_lines(df.limit(0)).count() == 0
    share = {(x.record_id, x.line_no) for x in lines.repeated_lines(df, min_share=0.9).collect()}
    assert share < brute_repeated(rows) and lines.repeated_lines(df, min_share=0.01).count() == len(brute_repeated(rows))


# ---- splitting


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab .!?\n,가나다🙂", min_size=0, max_size=400), st.integers(12, 60), st.integers(0, 11))
def test_pieces(spark, text, limit, overlap):
    row = spark.createDataFrame([(text,)], "t string").select(splitting.pieces(F.col("t"), limit, overlap).alias("p")).first().p
    ends = [p.char_end for p in row]
    assert all(0 < p.char_end - p.char_start <= limit for p in row)
    assert all(b.char_start == max(0, a.char_end - overlap) for a, b in zip(row, row[1:]))
    assert (ends[-1] if ends else 0) == len(text) and ends == sorted(set(ends))


def test_split_at_boundaries(spark):
    text = ("Sentence one is here. " * 30).strip() + "\n\n" + "Second paragraph follows now. " * 40
    rows = [(1, text, "x"), (2, "short", "x"), (3, None, "x"), (4, "", "x"), (5, "x" * 5000, "x"), (5, "x" * 5000, "x"), (6, "🙂" * 901, "x")]
    df = spark.createDataFrame(rows, "id bigint, body string, piece_no string")
    got = splitting.split_oversized(df, "id", "body").orderBy("id", "piece_no").collect()
    assert {r.id for r in got} == {1, 5, 6}
    first = [r for r in got if r.id == 1]
    assert first[0].piece.endswith("\n\n") and all(r.piece == text[r.char_start : r.char_end] for r in first)
    assert all(re.search(r"[.\n]\s*$", r.piece) for r in first)
    with pytest.raises(ValueError):
        splitting.pieces(F.col("t"), 10, 10)


# ---- near duplicates


def sets_of(rows, width, least):
    out = {}
    for i, t, _ in rows:
        w = re.findall("[0-9a-z가-힣]+", (t or "").lower())
        s = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
        if len(s) >= least:
            out[i] = s
    return out


@pytest.mark.parametrize("width,threshold,least,hot", [(3, 0.5, 5, 20000), (5, 0.8, 1, 4), (3, 0.5, 5, 3)])
def test_near_duplicates_like_brute_force(spark, width, threshold, least, hot):
    r = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["가나", "다라"]
    base = [[r.choice(words) for _ in range(r.randint(10, 40))] for _ in range(12)]
    rows = []
    for i in range(160):
        b = list(r.choice(base))
        for _ in range(r.randint(0, 5)):
            k = r.randrange(len(b))
            b[k : k + 1] = r.choice([[], [r.choice(words)], [b[k], r.choice(words)]])
        rows.append((i, " ".join(b), "x"))
    rows += [rows[3], (500, rows[3][1].upper() + "!", "x"), (501, None, "x"), (502, "", "x"), (503, "one two", "x"), (504, " ".join(f"z{i}" for i in range(20000)), "x")]
    df = spark.createDataFrame(rows, "id bigint, text string, class_id string")
    members, pairs = neardup.near_duplicates(df, "id", "text", width=width, threshold=threshold, least=least, hot=hot)
    s = sets_of(rows, width, least)
    want = {(a, b) for a, b in itertools.combinations(sorted(s), 2) if len(s[a] & s[b]) >= threshold * len(s[a] | s[b])}
    got = [(x.record_a, x.record_b) for x in neardup.record_pairs(members, pairs).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {x.id for x in members.collect()} == set(s)
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in sorted(want):
        x, y = sorted((find(a), find(b)))
        root[y] = x
    grouped = {x.record_id: x for x in neardup.groups(members, pairs).collect()}
    assert grouped.keys() == s.keys() and all(grouped[i].links == sum(i in p for p in want) for i in s)
    assert len({(find(i), grouped[i].group_id) for i in s}) == len({find(i) for i in s}) == len({g.group_id for g in grouped.values()})


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001)]
    random.Random(1).shuffle(chain)
    got = {r.id: r.root for r in neardup.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_unsettled_components_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)], "a bigint, b bigint")
    with pytest.raises(RuntimeError):
        neardup.components(chain, most_rounds=1)


def test_vantage_tree_finds_all_pairs():
    r = np.random.default_rng(1)
    fp = r.integers(0, 2**63, (700, 2), dtype=np.uint64)
    fp[300:] = fp[r.integers(0, 40, 400)] ^ (np.uint64(1) << r.integers(0, 63, (400, 2), dtype=np.uint64))
    size = r.integers(20, 60, 700).astype(np.int32)
    i, j = neardup.VantageTree(fp, size, 1 / 3).pairs()
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    d = np.bitwise_count(fp[:, None, :] ^ fp[None, :, :]).sum(axis=2)
    want = {(a, b) for a, b in itertools.combinations(range(700), 2) if d[a, b] <= (size[a] + size[b]) / 3 + 1e-9}
    assert got == want and len(i) == len(got)
    assert len(neardup.VantageTree(np.zeros((200, 2), np.uint64), np.full(200, 9, np.int32), 1 / 3).pairs()[0]) == 200 * 199 // 2


def test_near_duplicates_of_nothing(spark):
    members, pairs = neardup.near_duplicates(spark.createDataFrame([], "id bigint, text string"), "id", "text")
    assert members.count() == pairs.count() == 0


# ---- tokenizer and packing


@pytest.fixture(scope="module")
def public():
    import tiktoken

    ranks = tokenizer.load_ranks(tokenizer.DEFAULT_VOCABULARY)
    return tokenizer.Encoder(), tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aeinrst 's가나0\n", max_size=80)))
def test_encoding_is_the_public_one(public, text):
    ours, theirs = public
    text = text.encode("utf-8", "ignore").decode()
    ids = ours.encode(text)
    assert ids == theirs.encode_ordinary(text)
    assert "".join(ours.decode(ids)) == text


def test_encoding_long_and_forgotten(public):
    ours, theirs = public
    for t in ("a" * 20000, " " * 9000 + "x", "가나" * 4000, "-_" * 5000):
        assert ours.encode(t) == theirs.encode_ordinary(t)
    small = tokenizer.Encoder(most=3)
    small.transducer.max_states = 10
    assert small.encode("many different words stand here, again and again") == theirs.encode_ordinary("many different words stand here, again and again")
    m = tokenizer.Utf8()
    assert m.feed(b"\xea\xb0") == "" and m.feed(b"\x80x") == "가x" and m.feed(b"\xff\xe0") == "�" and m.end() == "�"


def test_encode_documents(spark, public):
    rows = [(1, "Hello 세계", "x"), (2, None, "x"), (3, "", "x"), (1, "Hello 세계", "x"), (4, "word " * 20000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = [(r.doc_id, r.ids) for r in tokenizer.encode_documents(df).collect()]
    want = [(i, public[1].encode_ordinary(t) if t else []) for i, t, _ in rows]
    assert sorted(got) == sorted(want)
    assert tokenizer.encode_documents(df.limit(0)).count() == 0
    packed = packing.pack_documents(df, shard_tokens=30_000).collect()
    assert {(r.doc_id, r.token_start) for r in packed if r.doc_id == 4} == {(4, k) for k in range(0, len(want[4][1]), 2048)}
    assert sum(r.n_tokens for r in packed) == sum(len(x) for _, x in want) and {r.doc_id for r in packed} == {1, 2, 3, 4}
    load = {}
    for r in packed:
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
    assert max(load.values()) <= 2048
    assert packing.pack_documents(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=80))
def test_balance_never_overfills(sizes):
    at = packing.balance(np.array(sizes, np.int64), 100, 1 / 50)
    load = {}
    for n, c in zip(sizes, at):
        load[int(c)] = load.get(int(c), 0) + n
    assert len(at) == len(sizes) and all(v <= 100 for v in load.values())


# ---- residue


def test_residue(spark):
    text = "The council met on Tuesday and agreed on the budget for the coming year, officials said in a statement."
    menu = "Home\nNews\nContact\n"
    rows = [(i, f"https://s{i % 4}.example/p{i}", menu + text + f" It was item {i}.", "x") for i in range(40)]
    rows += [(100, "https://s0.example/e", menu + "404 Not Found\nnginx", "x"), (101, "https://s1.example/e", menu + "{{ article.title }}\nundefined", "x"), (102, "https://s2.example/e", "Please enable JavaScript to view this page.", "x"),
             (103, "https://s3.example/e", menu + text + "\nundefined\n{{ title }}", "x"), (104, None, None, "x"), (105, "https://s1.example/f", "  \n ", "x"), (106, "https://s1.example/g", menu, "x"),
             (107, "https://s2.example/l", "Lorem ipsum dolor sit amet elit sed augue purus. " * 400, "x"), (108, "https://s2.example/m", text * 900, "x"), (101, "https://s1.example/e", menu + "{{ article.title }}\nundefined", "x")]
    df = spark.createDataFrame(rows, "page_id bigint, final_url string, text string, line string")
    got = [r.page_id for r in residue.residue_pages(df).collect()]
    assert sorted(got) == [100, 101, 102, 107]
    assert residue.residue_pages(df.limit(0)).count() == 0


def test_every_line_that_a_rule_takes_is_found(spark):
    alone = ["Ut enim ad minim veniam quis nostrud exercitation ullamco", "HTTP:404", "HTTP404", "cloudflare", "openresty/1.19.3", "IIS/10.0", "404 Not  Found", "Too  many requests"]
    mixed = [f"{x}\nThe council of town {'abcdefgh'[i]} met on Tuesday and agreed on the budget for the coming year." for i, x in enumerate(alone)]
    rows = [(i, f"https://s{i}.example/p", t) for i, t in enumerate(alone + mixed)]
    got = residue.residue_pages(spark.createDataFrame(rows, "page_id bigint, final_url string, text string")).collect()
    assert sorted(r.page_id for r in got) == list(range(len(alone)))
    one = spark.createDataFrame([("A  Mail to Jo.D@x.Example\t\n \n\u3000On 4 May 2024, see http://a.example/b  \n",)], "t string")
    assert one.select(residue.masked_lines(F.col("t"))).first()[0] == ["a mail to <addr>", "", "on <day>, see <addr>", ""]


def test_long_lines_that_recur_or_are_residue(spark):
    notice = "이 서비스는 필수적인 기록만 저장하며 자세한 내용은 안내문에서 볼 수 있습니다 " * 9
    script = "Please enable JavaScript to go on, " + "because the parts of this page are put together while it is read " * 6
    other = "The council met on Tuesday and agreed on the budget for the coming year " * 6
    rows = [(i, f"https://s{i % 4}.example/p{i}", notice + f"\nThe market of town {'abcdefghijkl'[i]} was opened by its guests in the early morning.") for i in range(12)]
    rows += [(100, "https://s0.example/e", notice + "\n404 Not Found\nnginx"), (101, "https://s1.example/e", script), (102, "https://s1.example/f", other + "\n404 Not Found"), (103, "https://s2.example/f", notice + "\n" + other + "\nundefined")]
    df = spark.createDataFrame(rows, "page_id bigint, final_url string, text string")
    assert sorted(r.page_id for r in residue.residue_pages(df).collect()) == [100, 101]


# ---- main body


def test_main_body(spark):
    r = random.Random(5)
    nouns = "river bridge council market museum harbour garden engine winter letter".split()
    rows = []
    for i in range(160):
        site = f"https://daily-{i % 8}.example/a{i}"
        body = [f"The {r.choice(nouns)} near the {r.choice(nouns)} was repaired after {r.randint(2, 90)} days of careful work by the {r.choice(nouns)}." for _ in range(r.randint(2, 6))]
        name = lambda: "".join(r.choice("bdklmnrst") + r.choice("aeiou") for _ in range(4)).title()
        head = f"How {name()} changed the {r.choice(nouns)} of {name()}"
        rows.append((i, site, "\n".join(["Menu", "Home | News | Contact", head, "By A. Writer", "2024-01-02", *body, "", "Share", "Related stories", f"How {name()} left the {r.choice(nouns)}", "All rights reserved."])))
    df = spark.createDataFrame(rows, "record_id bigint, final_url string, text string")
    extra = spark.createDataFrame([(900, None), (901, ""), (902, " \n "), (0, rows[0][2])], "record_id bigint, text string")
    got = {}
    for x in blocks.main_body(df, df.select("record_id", "text").unionByName(extra)).collect():
        got.setdefault(x.record_id, set()).add(x.line_no)
    right = sum(got.get(i, set()) == {3, *range(6, t.split("\n").index("", 3) + 1)} for i, _, t in rows)
    assert right >= 0.9 * len(rows) and not {900, 901, 902} & got.keys()
    assert blocks.main_body(df.limit(0), df.select("record_id", "text").limit(0)).count() == 0


def test_recurrence_is_counted_over_all_pages(spark, monkeypatch):
    word = lambda i: "".join("bdklmnrstv"[int(c)] + "a" for c in f"{i:03}")
    rows = []
    for i in range(400):
        foot = f"All texts of this place are written by the volunteers of {word(i // 4)} town."
        rows.append((i, f"https://site-{word(i // 4)}.example/a{i}", f"The {word(i)} bridge near the {word(i + 400)} market was repaired after weeks of work.\n{foot}"))
    rows += [(400 + i, "https://lone.example/a", "A notice of one address that stands on many copies of the page.\nThe bridge was closed for a day.") for i in range(5)]
    seen = []
    fit = blocks.Labeller.fit
    monkeypatch.setattr(blocks.Labeller, "fit", lambda self, pages, labels, epochs: seen.extend(labels) or fit(self, pages, labels, 1))
    df = spark.createDataFrame(rows, "record_id bigint, final_url string, text string")
    blocks.main_body(df, df.select("record_id", "text").limit(1), max_pages=20).count()
    assert len(seen) == 20 and all(list(y) == [1, 0] for y in seen)
    every = [(lines.site(F.col("final_url")).alias("s")), "final_url", "text"]
    wide, own = blocks.recurrent_lines(df.select(*every), [("lone.example", rows[400][2]), ("site-bababa.example", rows[0][2])])
    assert not wide and own == {("site-bababa.example", blocks.normal(rows[0][2].split("\n")[1], ""))}


def test_gradient_of_the_labeller():
    lab = blocks.Labeller(frozenset({"a", "b"}))
    pages = [lab.features.page(["a b", "", "b.", "c 1"]), lab.features.page(["a"])]
    y = [np.array([1, 0, 1], np.float32), np.array([0], np.float32)]

    def loss():
        z = lab.scores([lab.inputs(*p[:3]) for p in pages])
        return sum(float(np.sum(np.logaddexp(0, -(2 * t - 1) * s))) for s, t in zip(z, y))

    before = loss()
    lab.fit(pages, y, epochs=60)
    assert loss() < 0.2 * before
    x = np.random.default_rng(2).normal(size=(950, lab.inputs(*pages[0][:3]).shape[1])).astype(np.float32)
    assert np.allclose(lab.long_scores(x), lab.scores([x])[0], atol=1e-4)
    long = "\n".join(["a b"] * 1000)
    assert all(1 <= n <= 1000 for n in lab.main_lines([long, None, ""])[0])


# ---- subjects


def test_sentences_and_subjects(spark):
    assert subjects.sentences('One e.g. the other by G. Smith ended. "Yes," he said.\n둘은 같다. 셋이다.') == ["One e.g. the other by G. Smith ended.", '"Yes," he said.', "둘은 같다.", "셋이다."]
    assert subjects.sentences(None) == subjects.sentences("… \n") == []
    r = random.Random(3)
    words = {"sport": ["goal", "coach", "league", "match", "골키퍼"], "law": ["court", "judge", "appeal", "clause", "법원"]}
    def sentence(s):
        return f"The {r.choice(words[s])} and the {r.choice(words[s])} met in the hall." if s else "The folder and the errand met in the hall."
    docs, labels, truth = [], [], {}
    for i in range(300):
        mix = r.choice([["sport"] * 6, ["law"] * 6, ["sport"] * 4 + ["law"] * 3, [None] * 5, ["law"] * 9 + ["sport"]])
        docs.append((i, " ".join(sentence(s) for s in mix)))
        truth[i] = {s for s in set(mix) if s and mix.count(s) >= 0.2 * len(mix)}
        if i % 2 and truth[i]:
            labels += [(i, s if r.random() > 0.05 else "law") for s in truth[i]]
    docs += [(900, None), (901, ""), (902, " "), (903, " ".join(sentence("law") for _ in range(3000)))]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    l = spark.createDataFrame(labels, "doc_id bigint, subject string")
    got = {}
    for x in subjects.subject_areas(d, l).collect():
        got.setdefault(x.doc_id, set()).add(x.subject)
    held = [i for i in truth if not i % 2]
    assert sum(got.get(i, set()) == truth[i] for i in held) >= 0.97 * len(held)
    assert got[903] == {"law"} and not {900, 901, 902} & got.keys()
    assert subjects.subject_areas(d, l.limit(0)).count() == 0


def test_repeated_long_sentences_are_mined_in_time(spark):
    ws = ["".join("bdklmnrstv"[int(c)] + "a" for c in f"{i:03}") for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(ws) + f". The court met {'abcdefghij'[i % 10]} judge.") for i in range(50)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, "law") for i in range(50)] + [(0, "sea x")], "doc_id bigint, subject string")
    began = time.time()
    rules = subjects.mine(docs, labels, min_count=4)
    assert rules and max(len(a) for a, *_ in rules) <= 2 and time.time() - began < 120


@pytest.mark.parametrize("dense,also", [(0.6, ["x"]), (0.25, [])])
def test_rules_of_any_length_like_brute_force(spark, dense, also):
    r = random.Random(7)
    rows = []
    for i in range(900):
        ws = sorted(w for w in ("anchor", "beacon", "cable", "dock", "engine", "ferry") if r.random() < dense) or ["ferry"]
        sure = {"anchor", "beacon", "cable"} <= set(ws) or {"cable", "dock", "engine", "ferry"} <= set(ws)
        sure = sure or not also and len(ws) > 1 and r.random() < 0.6  # lone words are less sure
        rows.append((i, ws + also, ["sea"] * (r.random() < (0.98 if sure else 0.3)) + ["air"] * (r.random() < 0.4) or ["none"]))
    docs = spark.createDataFrame([(i, " ".join(ws)) for i, ws, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, s) for i, _, subs in rows for s in subs], "doc_id bigint, subject string")
    got = {(a, s): round(c, 9) for a, s, c, _ in subjects.mine(docs, labels)}
    words = [w for w in ("anchor", "beacon", "cable", "dock", "engine", "ferry", "x") if any(2 * sum(w in ws and s in subs for _, ws, subs in rows) >= max(4, sum(w in ws for _, ws, _ in rows)) for s in ("sea", "air", "none"))]
    conf = {}
    for k in range(1, 7):
        for a in itertools.combinations(words, k):
            held = [subs for _, ws, subs in rows if {*a} <= {*ws}]
            for s in ("sea", "air", "none"):
                n = sum(s in subs for subs in held)
                if n >= 4:
                    conf[a, s] = (n + 2 * sum(s in subs for *_, subs in rows) / 900) / (len(held) + 2)
    want = {(a, s): round(min(c, 0.995), 9) for (a, s), c in conf.items() if c >= 0.5 and all(conf[b, s] + 0.05 < c for k in range(1, len(a)) for b in itertools.combinations(a, k))}
    assert got == want and max(len(a) for a, _ in got) >= (4 if also else 2)
    judge = subjects.Rules([(("anchor", "beacon", "cable"), "sea", 0.9, 0.4)], 1.5)
    assert judge.subject("A beacon, a cable, anchors.") == "sea" and judge.subject("A beacon and anchors.") is None


# ---- scans


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
    return d[-1]


def test_automaton_and_trie_find_every_candidate():
    r = random.Random(9)
    words = {"".join(r.choice("abce") for _ in range(r.randint(2, 6))): 1 for _ in range(400)}
    t = scans.Trie(words)
    for _ in range(200):
        w = "".join(r.choice("abcef") for _ in range(r.randint(2, 6)))
        got = t.within(w, cheap=0, dear=1)
        assert set(got) == {v for v in words if edits(w, v) <= 1}
    assert scans.Trie({"modern": 1}).within("rnodem", cheap=2, dear=0) == {"modern": (0, 2)}


def test_page_numbers():
    assert all(map(scans.is_page_number, ["12", "- 12 -", "— l9 —", "p. 7O", "Page 3 of 90", "[4]", "xxiv", "· 8 ·", "12쪽", "llO"]))
    assert not any(map(scans.is_page_number, ["9.9", "hill", "of", "", "12 apples", "1,234", "mix it"]))


def test_scan_defects_and_repair(spark):
    plain = "The surgeon treated the patient before the second inspection of the long weekend and the quiet summary was repeated."
    trusted = spark.createDataFrame([(plain,)] * 90 + [(None,), ("",)], "t string")
    head = "Notes on the harbour of Elmouth"
    rows = []
    for p in range(6):
        rows.append((p, "doc-1", "ocr_text", f"{head}\nThe sur9eon treated the pa-\ntient before the secorid inspection of the\nlong weekend and the quiet summary\nwas repeated.\n- {p + 1} -", "x"))
    rows += [(50, "d", "text_sentence", "The quiet sum-\nmary was repeated.", "x"), (51, None, "ocr_text", None, "x"), (52, "d", "ocr_text", "", "x"), (53, "d", "caption", "plain", "x"), rows[0], (54, "e", "ocr_text", "summary " * 30000, "x")]
    df = spark.createDataFrame(rows, "unit_id bigint, doc_id string, source_type string, content string, defect string")
    got = [(r.unit_id, r.line_no, r.defect) for r in scans.scan_defects(df, trusted).collect()]
    want = {(p, n, k) for p in range(6) for n, k in ((1, "running_head"), (2, "wrong_char"), (2, "split_word"), (3, "wrong_char"), (6, "page_number"))} | {(50, 1, "split_word")}
    assert len(got) == len(set(got)) and set(got) == want
    fixed = {r.unit_id: r.content for r in scans.scan_defects(df, trusted, repair=True).collect()}
    assert fixed[2] == plain and fixed[52] == ""
    assert scans.scan_defects(df.limit(0), trusted.limit(0)).count() == 0


def test_every_edit_is_ranked_with_its_context():
    words = {w: 9 for w in "winter report budget window committee summary minter".split()}
    reader = scans.Reader(words, {scans.pair("the", "winter"): 5}, 100)
    told = {"wimter": "winter", "wjnter": "winter", "repozt": "report", "budqet": "budget", "windcw": "window", "comrnjttee": "committee", "zinter": "winter"}
    assert {t: reader.correct(t, "the", "of") for t in told} == told
    assert all(reader.correct(t, "the", "of") is None for t in ("harbour", "reports", "sum", "budge"))  # nothing near, or another form without support
    r = random.Random(4)
    vocabulary = {"".join(r.choice("abcernm") for _ in range(r.randint(4, 8))): 1 for _ in range(500)}
    t = scans.Trie(vocabulary)
    for _ in range(60):
        w = r.choice(sorted(vocabulary))
        k = r.randrange(len(w))
        damaged = w[:k] + r.choice(["", "x", w[k] + "x"]) + w[k + 1 :]
        assert w in t.within(damaged, cheap=2, dear=1)


def test_the_cache_bounds_nothing_but_the_broadcast(spark):
    units = spark.read.parquet("/root/testdata/sf0.01/evidence_units.parquet")
    trusted = units.where("source_type <> 'ocr_text'").select(F.col("content").alias("t"))
    bounds = [{}, {"max_shapes": 40, "max_words": 300, "max_pairs": 20, "block": 4000}]
    found = [{tuple(r) for r in scans.scan_defects(units, trusted, **b).collect()} for b in bounds]
    assert found[0] == found[1] and {d for _, _, d in found[0]} == {"running_head", "wrong_char", "split_word", "page_number"}


def test_every_pair_of_words_is_a_neighbour(spark):
    said = "The budget committee met again."
    trusted = spark.createDataFrame([(f"{said} Word{i} of number{i} stands alone.",) for i in range(40)] + [("Some filler words stand in many lines.",)] * 4000, "t string")
    units = spark.createDataFrame([(1, "d", "ocr_text", "The budget committe met again.")], "unit_id bigint, doc_id string, source_type string, content string")
    for bounds in ({}, {"max_words": 5, "max_pairs": 2}):  # 40 of 28,000 words; as it is, and looked up beside the cache
        assert [tuple(r) for r in scans.scan_defects(units, trusted, **bounds).collect()] == [(1, 1, "wrong_char")]
        assert [r.content for r in scans.scan_defects(units, trusted, repair=True, **bounds).collect()] == [said]


def test_neighbours_by_chance_are_no_evidence():
    words = {"konex": 7, "of": 9000}
    assert scans.Reader(words, {scans.pair("of", "konex"): 2}, 290_000).correct("wonex", "of", "at") is None
    assert scans.Reader(words, {scans.pair("of", "konex"): 40}, 290_000).correct("wonex", "of", "at") == "konex"


def test_bodies_hold_whatever_heads_go():
    lines = ["THE HEAD exam-", "ple of a body", "that ends in a bro-", "KEN HEAD", "12"]
    assert scans.bodies(lines) == [[0, 1, 2, 3], [1, 2, 3], [0, 1, 2], [1, 2]]
    assert scans.bodies(["A HEAD", "and a body"]) == [[0, 1]] and scans.bodies([""]) == [[0]]


def test_a_worker_keeps_runs_apart():
    class Model:
        value = ("first", {"winter": 9}, {}, 100)

    model = Model()
    assert "winter" in scans.reader_of(model)
    model.value = ("second", {"summer": 9}, {}, 100)  # another broadcast at the same place in memory
    assert "winter" not in scans.reader_of(model) and "summer" in scans.reader_of(model)
