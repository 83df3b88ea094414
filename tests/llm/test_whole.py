"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

import random
import re

from html import escape as html_escape
from html import unescape as html_unescape

from test_operators import prose, shingle_set, slow_score

from tallyspark.llm import decontamination, html_density, line_dedup, ngram_join, toxicity_grammar


def test_decontamination_edited(spark):
    """Copies with 10 to 25 % of the words replaced, and halves, beside exact ones: all that share a 4-gram with the item."""
    r = random.Random(8)
    items = {k: prose(600 + k, 12 + 2 * k) for k in range(8)}
    rows = []
    for k, t in items.items():
        words = t.split()
        copies = [words, words, words[: len(words) // 2 + 1], words[len(words) // 2 - 1 :]]
        for share in (0.1, 0.15, 0.2, 0.25):
            for _ in range(3):
                edited = list(words)
                for at in r.sample(range(len(words)), max(1, int(share * len(words)))):
                    edited[at] = f"edit{r.randrange(10**6)}"
                copies.append(edited)
        rows += [" ".join([prose(len(rows) + j, 20), *c, prose(900 + len(rows) + j, 20)]) for j, c in enumerate(copies)]
    middle = items[2].split()
    middle[6:10:3] = ["two", "edits"]
    rows.append(" ".join(middle))  # two inner words of 16: 8 of 13 grams are broken
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    find = lambda common: {(x.doc_id, x.item_id): round(x.score, 6) for x in decontamination.best_matches(decontamination.contaminated(docs, bench, common=common)).collect()}
    got = find(32)
    score = {(d, k): slow_score(t, x) for d, x in enumerate(rows) for k, t in items.items() if shingle_set(t, 4) & shingle_set(x, 4)}
    want = {p: round(s, 6) for p, s in score.items() if s >= 0.5}
    assert got == want and (len(rows) - 1, 2) in want
    assert find(0) == want  # every gram counts as common


def test_decontamination_common_grams(spark):
    """Items and documents that share phrases by the hundred: the pairs are those of all pairs with a gram in common, whatever counts as common."""
    r = random.Random(3)
    phrases = ["which of the following is", "what is the name of the", "all of the above are true"]
    own = lambda k: " ".join(f"{p}{r.randrange(25)}" for p in ["ka", "lo", "mi", "nu"] * k)
    items = {k: f"{own(r.choice([1, 2]))} {phrases[k % 3]} {own(r.choice([1, 2, 12]))}" for k in range(90)}
    items |= {90: phrases[0], 91: phrases[0], 92: "of the", 93: ""}
    rows = [f"{own(2)} {phrases[k % 3]} {own(3)}" for k in range(60)]
    for k in range(0, 90, 4):
        words = items[k].split()
        for at in r.sample(range(len(words)), len(words) // 4):
            words[at] = "edited"
        rows.append(f"{own(1)} {' '.join(words)} {phrases[(k + 1) % 3]}")
    rows += ["", phrases[0], " ".join(rows)]
    docs, bench = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    find = lambda **how: {(x.doc_id, x.item_id): round(x.score, 6) for x in decontamination.best_matches(decontamination.contaminated(docs, bench, **how)).collect()}
    want = find(common=10**9)
    assert len(want) > 60 and all(find(**how) == want for how in ({}, {"common": 0}, {"common": 5}, {"common": 5, "block": 200}))
    plain = {(d, k): slow_score(t, x) for d, x in enumerate(rows[:-1]) for k, t in items.items() if k < 90 and shingle_set(t, 4) & shingle_set(x, 4)}
    assert {p: s for p, s in want.items() if p[0] < len(rows) - 1 and p[1] < 90} == {p: round(s, 6) for p, s in plain.items() if s >= 0.5}


def test_decontamination_is_linear_in_common_grams():
    """Documents and items with nothing in common but one phrase meet nowhere."""
    import time

    import pyarrow as pa

    class Shared:
        def __init__(self, value):
            self.value = value

    def seconds(n):
        r = random.Random(1)
        made = lambda p: [" ".join([*(f"{p}{k}w{r.randrange(10**6)}" for _ in range(12)), "which of the following is", f"{p}{k}v"]) for k in range(n)]
        items = decontamination.Items(list(range(n)), made("i"))
        batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(made("d"))], ["doc_id", "text"])
        start = time.process_time()
        assert list(decontamination._aligned(Shared(items), 0.5)([batch])) == []
        return time.process_time() - start

    assert seconds(4000) < 8 * max(0.1, seconds(1000))  # 16 times for all pairs


def test_ngram_repeated_rows_alone(spark):
    """Repeated rows in a table where no id has two texts: as many rows come out as go in."""
    a = prose(700, 60)
    near = " ".join([*a.split()[:-1], "other"])
    rows = [(1, a)] * 2 + [(2, near)] + [(5, prose(701, 60))] * 40 + [(6, " ".join([*prose(701, 60).split(), "more"])), (9, prose(702, 50)), (None, a), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for chunk in (512, 1):
        got = ngram_join.ngram_components(docs, chunk_docs=chunk).collect()
        assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == sorted((i or -1, {2: 1, 6: 5}.get(i, i) or -1) for i, _ in rows)


def test_html_whole_article():
    """Everything of an article that isn't named as something else, whatever its density and length."""
    p = lambda n, w: "<p>" + " ".join([w] * (n // len(w))) + "</p>"
    five, two = p(300, "long ") * 5, p(100, "brief ") * 2
    refs = "<ul>" + "".join(f"<li><a href=/{k}>reference number {k}</a></li>" for k in range(4)) + "</ul>"
    menu = "<div><a href=/a>first entry</a><a href=/b>second entry</a><a href=/c>third entry</a></div>"
    words = lambda h: html_density._SPACE.sub(" ", re.sub("<[^>]*>", " ", h)).strip()
    for inner in (f"<h1>{'A long title ' * 6}</h1><div>{five}</div>", f"<section>{five}</section><section>{two}</section>", f"<h2>Short</h2><div>{five}</div><p>End.</p>", f"<div>{five}</div>{refs}"):
        for tag in ("article", "main"):
            assert html_density.extract(f"<body><nav>home</nav>{menu}<{tag}>{inner}<div class=ad>buy</div></{tag}><footer>f</footer>") == words(inner)
    for inner in (f"<h1>{'A long title ' * 6}</h1><div>{five}</div>", f"<div>{five}</div><p>End.</p>"):
        assert html_density.extract(f"<body>{menu}<div>{inner}</div>") == words(inner)
    assert html_density.extract(f"<body><main>{menu}<h1>Title</h1><article>{five}</article></main>") == words(f"<h1>Title</h1>{five}")


def test_line_dedup_whole_copies(spark):
    """A copy of a whole text goes whole, whoever holds its lines first and however short they are."""
    one, two = "a common line of some words", "another line of some words"
    often = f"{one}\nits own line of the text\n{one}\nand one more of its own"
    verse = "\n".join(["short", "lines of", "a verse", "short", "are long", "together"])
    rows = [(1, one), (2, two), (3, f"{one}\nss\n{two}"), (4, f"{one}\nss\n{two}"), (5, often), (6, often), (7, verse), (8, verse), (9, verse + "\nand"), (10, "two\nwords"), (11, "two\nwords"), (12, "\n\n" + often)]
    out = {r.doc_id: (r.text.strip(), r.n_deleted) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[4] == ("", 3) and out[6] == ("", 4) and out[8] == ("", 6) and out[12] == ("", 4)
    assert out[1] == (one, 0) and out[3] == ("ss", 2) and out[5][1] == 1 and out[7] == (verse, 0) and out[11][1] == 0
    assert out[9] == ("and", 6)  # two neighbours of four words together bring them together, and the block is whole


def test_html_header_form_and_search():
    """An article's own header stays, a page inside one form is read, a small form goes; a bare sign is text, ties go to the first element."""
    p = "<p>" + "words of the article. " * 12 + "</p>"
    text = ("words of the article. " * 12).strip()
    get = html_density.extract
    assert get(f"<body><header><h1>Site</h1></header><article><header><h1>Title</h1></header>{p}</article>") == f"Title {text}"
    assert get(f"<body><form action=/><input><div>{p}{p}</div></form></body>") == f"{text} {text}"
    assert get(f"<body><form><main>{p}</main></form><div><a href=/>{'link ' * 200}</a></div>") == text
    assert get(f"<body><article>{p}<form><label>Your name</label><p>Send it</p></form></article>") == text
    assert get("<body><p>1 < 2 and a <3 b</p>") == "1 < 2 and a <3 b"
    assert get(f"<body><div>{p}</div><nav>x</nav><div>{'<a href=/>some link</a>' * 9}</div>") == text
    assert get(f'<a title="it\'s>"> </a><article a"b>{p}</article>') == text
    assert get(f"<article>{p}<p>unclosed <b title=\"x>y") == f"{text} unclosed y"
    wide = "<article>" + "<p>short piece of text</p>" * 4000 + "</article>"
    assert get(wide) == " ".join(["short piece of text"] * 4000)


def test_html_hostile_pages_are_linear():
    import time

    for make in (lambda n: "<div>" * n + "x" + "</span>" * n, lambda n: "<nav>" + "<div>" * n + "</b>" * n, lambda n: "<a " * n + '" >', lambda n: "<ul><li><ul>" + "<span>" * n + "<li></li>" * n):
        start = time.time()
        html_density.extract(make(100_000))
        assert time.time() - start < 10  # quadratic ones take minutes


def test_html_densities():
    """Densities and their sums by a recursive version over the standard library's parser, and the subtree with the maximum sum."""
    import math
    from html.parser import HTMLParser

    r = random.Random(3)

    def tree(depth):
        if depth == 0 or r.random() < 0.2:
            words = " ".join("word" for _ in range(r.randrange(1, 30)))
            return f"<a>{words}</a>" if r.random() < 0.3 else words
        tag = r.choice(["div", "section", "blockquote", "span", "b"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(r.randrange(1, 4))) + f"</{tag}>"

    for _ in range(30):
        page = "<body>" + "".join(tree(4) for _ in range(3)) + "</body>"
        root = {"tag": "#root", "kids": [], "text": []}
        stack = [root]

        class Reader(HTMLParser):
            def handle_starttag(self, tag, attrs):
                node = {"tag": tag, "kids": [], "text": []}
                stack[-1]["kids"].append(node)
                stack.append(node)

            def handle_endtag(self, tag):
                stack.pop()

            def handle_data(self, data):
                stack[-1]["text"].append(data)

        Reader().feed(page)

        def count(n):
            kids = [count(k) for k in n["kids"]]
            n["chars"] = sum(len(" ".join(x.split())) for x in n["text"]) + sum(k["chars"] for k in kids)
            n["tags"] = sum(k["tags"] + 1 for k in kids)
            link = n["tag"] == "a"
            n["lc"] = n["chars"] if link else sum(k["lc"] for k in kids)
            n["lt"] = n["tags"] + 1 if link else sum(k["lt"] for k in kids)
            return n

        body = count(root)["kids"][0]

        def density(n):
            c, t = n["chars"], max(1, n["tags"])
            if not c:
                return 0.0
            base = math.log(c / max(1, c - n["lc"]) * max(1, n["lc"]) + (body["lc"] + 1) / (body["chars"] + 1) * c + math.e)
            return c / t * math.log(max(1.0, c / max(1, n["lc"]) * t / max(1, n["lt"])) + 1) / base

        def flat(n):
            return [n, *(x for k in n["kids"] for x in flat(k))]

        got = html_density.weigh(html_density.parse(page))
        want = flat(root)
        assert [n.tag for n in got] == [n["tag"] for n in want]
        sums = [sum(density(k) for k in n["kids"] if k["tag"] not in html_density.INLINE) for n in want]
        for g, w, total in zip(got, want, sums):
            assert (g.chars, g.tags, g.link_chars, g.link_tags) == (w["chars"], w["tags"], w["lc"], w["lt"])
            assert abs(g.density - density(w)) < 1e-9 and abs(g.sum - total) < 1e-9


def test_line_dedup_whole_blocks(spark):
    """A common block goes with its common lines, which others hold too; the same lines elsewhere stay."""
    often = [f"common line number {k} of everybody" for k in range(4)]
    block = ["rare first line of the block", *often[:2], often[2], often[3], "rare last line of the block"]
    rows = [(k, "\n".join([*often, f"an own line of document {k}"])) for k in range(30)]
    rows += [(100, "\n".join([often[3], "head of one hundred", *block, "tail of one hundred"])), (200, "\n".join([often[0], "head of two hundred", *block, "tail of two hundred", often[1]]))]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[200].text.split("\n") == [often[0], "head of two hundred", "tail of two hundred", often[1]]
    assert got[200].n_deleted == 6 and got[100].n_deleted == 0
    assert [(b.first, b.last, b.partner) for b in got[200].blocks] == [(2, 7, 100)]


def test_line_dedup_recall(spark):
    """Blocks that documents took from earlier ones, with common lines among theirs: at least nine tenths of their lines go, and nothing of the own ones."""
    r = random.Random(17)
    often = [f"common line number {k} here" for k in range(6)]
    rows, own, taken = [], {}, {}
    for d in range(160):
        x = [(f"line {j} of document {d} {prose(d * 50 + j, r.choice([1, 3, 8]))}", "own") for j in range(r.randrange(3, 14))]
        x += [(r.choice(often), "common") for _ in range(r.randrange(3))]
        r.shuffle(x)
        if d > 20 and r.random() < 0.6:
            source = [s for s, _ in rows[r.randrange(d)][1]]
            a = r.randrange(len(source))
            part = source[a : a + r.randrange(2, 8)]
            if any(s not in often for s in part):
                at = r.randrange(len(x) + 1)
                x[at:at] = [(s, "taken") for s in part]
        rows.append((d, x))
    docs = spark.createDataFrame([(d, "\n".join(s for s, _ in x)) for d, x in rows], "doc_id long, text string").repartition(4)
    hit = all_of = 0
    for x in line_dedup.dedup_lines(docs).collect():
        gone = {k for b in x.blocks or [] for k in range(b.first, b.last + 1)}
        kinds = [kind for _, kind in rows[x.doc_id][1]]
        hit += sum(kinds[k] == "taken" for k in gone)
        all_of += kinds.count("taken")
        assert not any(kinds[k] == "own" for k in gone)
    assert all_of > 200 and hit >= 0.9 * all_of


def test_line_dedup_long_partners(spark):
    """One document of many thousand lines, of which each of many others took a block."""
    long = [f"line number {k} of the long one" for k in range(6000)]
    rows = [(0, "\n".join(long))] + [(k, "\n".join([f"own line of document {k}", *long[k * 20 : k * 20 + 15]])) for k in range(1, 290)]
    rows += [(1000, "\n".join([x for k in range(1, 290) for x in (f"own line of document {k}", "and one of the last")]))]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k].text == f"own line of document {k}" for k in range(1, 290)) and got[0].n_deleted == 0
    assert got[1000].n_deleted == 289 and set(got[1000].text.split("\n")) == {"and one of the last"}


def test_toxicity_long_texts():
    """Many clauses in one text: the time is that of its length, and each clause counts as it does alone."""
    import time

    lexicon = toxicity_grammar.Lexicon({"idiot$": 1.0})
    r = random.Random(2)
    clauses = [r.choice(["you idiot", "he said idiot", "not an idiot", "fine words", "idiot idiot"]) + r.choice([".", "!", "?", ";", ":", ",", "\n"]) + r.choice(["", " "]) for _ in range(400)]
    want = sum(toxicity_grammar.clause_kinds(c, lexicon) for c in clauses)
    assert (toxicity_grammar.clause_kinds("".join(clauses), lexicon) == want).all()

    def seconds(n):
        start = time.process_time()
        assert toxicity_grammar.clause_kinds("you idiot. " * n, lexicon).sum() == n
        return time.process_time() - start

    assert seconds(160_000) < 10 * max(0.05, seconds(40_000))


def test_html_names_inside_an_article():
    """What a name says goes by whole words there; titles, and paragraphs with a word of the list in their names, stay."""
    body = "<p>" + "Long enough to be the text of an article. " * 8 + "</p>"
    words = lambda h: html_density._SPACE.sub(" ", re.sub("<[^>]*>", " ", h)).strip()
    stay = ["<div class='entry-header'><h1>A title</h1></div>", "<p class='share-price'>The price of a share.</p>", "<p class='banner-headline'>A headline.</p>", "<div class='social-science'>About society.</div>", "<h2 class='related-title'>Related work</h2>", "<div class='ad-hoc'>Made for it.</div>", "<div id='articleHeader'>By somebody</div>"]
    go = ["<div class='comments'>I disagree.</div>", "<div class='post-comments'>Me too.</div>", "<section id='comments-area'>Not me.</section>", "<div class='share-buttons'>Send</div>", "<div class='relatedPosts'>Read on</div>", "<div class='ad'>Buy</div>", "<div class='newsletter-signup'>Mail</div>", "<p class='ad'>Buy more</p>"]
    for tag in ("article", "main"):
        for x in stay:
            assert html_density.extract(f"<body><nav>home</nav><{tag}>{x}{body}</{tag}><footer>f</footer>") == words(x + body), x
        for x in go:
            assert html_density.extract(f"<body><nav>home</nav><{tag}>{body}{x}</{tag}><footer>f</footer>") == words(body), x


def test_html_small_menus_go_by_place():
    body = "".join(f"<p>{'Text of the page without any article. ' * 6}{k}</p>" for k in range(4))
    menu, links = "<div><a href=/a>Home</a> <a href=/b>About</a></div>", "<div>see <a href=/x>one reference of the text</a></div>"
    words = lambda h: html_density._SPACE.sub(" ", re.sub("<[^>]*>", " ", h)).strip()
    assert html_density.extract(f"<body><div>{menu}{body}{menu}</div>") == words(body)
    assert html_density.extract(f"<body><div>{body}{links}{body}</div>") == words(body + links + body)
    assert html_density.extract(f"<body><div>{menu}</div>") == "Home About"


def test_html_made_pages():
    """Pages put together of known parts, in article elements and without: the text is that of the parts that are text, in their order."""
    r = random.Random(21)
    sentence = lambda k: f"Sentence {k} of the text, which goes on for a while & ends here."
    parts = lambda k: r.choice([lambda: f"<p>{html_escape(sentence(k))}</p>", lambda: f"<h2>Title {k}</h2><p>{html_escape(sentence(k))}</p>", lambda: f"<blockquote><p>{html_escape(sentence(k))}</p></blockquote>", lambda: f"<ul><li>{html_escape(sentence(k))}<li>and {k} more</ul>", lambda: f"<div>{html_escape(sentence(k))} <a href=/l>a link</a> and on.</div>"])()
    noise = ["<div class=ad>Buy this now</div>", "<nav><a href=/>Home</a></nav>", "<aside>By the way</aside>", "<div id=comments><p>No!</p></div>", "<script>var x = '<p>no</p>'</script>", "<style>p {}</style>", "<form><input>Search</form>", "<div role=banner>Welcome</div>", "<!-- <p>no</p> -->"]
    hit = 0
    for n in range(60):
        text = [parts(k) for k in range(r.randrange(6, 14))]
        mixed = [x for t in text for x in ([t] if r.random() < 0.7 else [r.choice(noise), t])]
        wrap = r.choice(["<article>{}</article>", "<main>{}</main>", "<div><article>{}</article></div>", "<div>{}</div>"])
        page = "<html><head><title>t</title></head><body>" + r.choice(noise) + wrap.format("".join(mixed)) + r.choice(noise) + "<footer>f</footer></body></html>"
        want = html_density._SPACE.sub(" ", html_unescape(re.sub("<[^>]*>", lambda m: "" if m[0].startswith(("<a", "</a")) else " ", "".join(text)))).strip()
        hit += html_density.extract(page) == want
    assert hit >= 57


def test_long_labelled_texts_are_drawn_from_all_over(spark):
    from pyspark.sql import functions as F

    texts = {"short": "é" * 160, "long": "".join(f"{k:08d}" for k in range(10_000)), "none": None, "empty": ""}
    df = spark.createDataFrame(list(texts.items()), "id string, text string").select("id", toxicity_grammar.spread(F.col("text"), 160).alias("t"))
    got = {r.id: r.t for r in df.collect()}
    assert got["short"] == texts["short"] and got["none"] is None and got["empty"] == ""
    pieces = got["long"].split("\n")
    step = (80_000 - 10) / 15
    assert pieces == [texts["long"][int(k * step) :][:10] for k in range(16)]


def plain_score(text, stems, weights):
    """The score of a text by whole clauses: cut at marks, classes word by word, no transducers."""
    kinds = [0.0] * len(toxicity_grammar.KINDS)
    lexicon = toxicity_grammar.Lexicon(stems)
    for clause in re.split(r"[.!?;:,\n]", text.lower()):
        symbols = [(w, lexicon.symbol(w)) for w in toxicity_grammar._WORD.findall(clause)]
        best = {}
        for k, (w, s) in enumerate(symbols):
            if s not in "IH":
                continue
            near = lambda kind, reach: any(x == kind for _, x in symbols[max(0, k - reach) : k])  # noqa: B023, E731
            if near("N", 3):
                kind = 2
            elif near("R", 6):
                kind = 3
            else:
                kind = {"I": (0, 1), "H": (4, 5)}[s][near("T", 4)]
            best[kind] = best.get(kind, 0.0) + (lexicon.weight(w) or 1.0)
        for kind, v in best.items():
            kinds[kind] += v
    return kinds, sum(min(v, 6.0) * w for v, w in zip(kinds, weights)) + weights[-1]


def test_toxicity_against_a_plain_scorer():
    """The composed transducers against rules that look back from each word."""
    import numpy as np

    stems = {"idiot$": 1.0, "stup+": 0.8, "moron$": 1.5}
    weights = np.append(toxicity_grammar.PRIOR, toxicity_grammar.BIAS)
    model = toxicity_grammar.Model(stems, weights)
    r = random.Random(14)
    pool = ["idiot", "stupid", "moron", "fine", "word", "tree", *sorted(toxicity_grammar.THREATS)[:3], *sorted(toxicity_grammar.CLASSES)[:: max(1, len(toxicity_grammar.CLASSES) // 25)]]
    texts = [" ".join(r.choice(pool) + r.choice(["", "", "", "", ".", ",", "!"]) for _ in range(r.randrange(1, 30))) for _ in range(400)]
    scores, kinds = model.score(texts)
    hit = 0
    for t, s, k in zip(texts, scores, kinds):
        want, z = plain_score(t, stems, weights)
        assert np.allclose(k, want) and abs(s - 1 / (1 + np.exp(-z))) < 1e-9, t
        hit += any(want)
    assert hit > 100
