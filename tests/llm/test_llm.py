"""Operators for training text against brute force, round trips and held-out data."""

import os
import random
from datetime import datetime

import pytest

pytest.importorskip("paneflow.llm")

from paneflow.llm.encoding import ForcedBoundaryEncoder, encode_corpus, encoder
from paneflow.llm.languages import LanguageModel, LanguageSpec, languages_of, normal_label, prose_of, segments, vector, wrong_labels
from paneflow.llm.leakage import LeakSpec, Matcher, leaks, words_of
from paneflow.llm.linkage import LabelModel, link
from paneflow.llm.pii import Doc, SkipChainCRF, find_personal_data, spans
from paneflow.llm.pii_training import examples
from paneflow.llm.text_forms import Forms, build_table, normalized, shown_labels
from pyspark.sql import functions as F

T0 = datetime(2025, 1, 1)
VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"


# ---- forms
@pytest.fixture(scope="module")
def table(spark):
    return build_table(spark)


@pytest.mark.parametrize("text", ["Ｓａｖｅ ｆｉｌｅ", "Sаvе ﬁle", " Save​ file ", "Save　file", "Sa­ve ⁠file", "Ѕave\tfile"])
def test_same_look(table, text):
    assert Forms(table).all(text)[1] == "Save file"


@pytest.mark.parametrize(("a", "b"), [("Save", "save"), ("Cafe", "Café"), ("m2", "m²"), ("file", "fi1e"), ("O0", "00"), ("Ill", "lll")])
def test_other_look(table, a, b):
    assert Forms(table).all(a)[1] != Forms(table).all(b)[1]


def test_labels_shown(spark, table):
    labels = spark.createDataFrame([(1, "Save file"), (2, "Café"), (3, None), (4, " ")], "label_id bigint, display string")
    runs = spark.createDataFrame([("c", "a", "Sаve file"), ("c", "b", "Save file"), ("c", "d", "Café"), ("c", "e", None), ("c", "f", "​"), ("c", "a", "Sаve file"), (None, "g", "Sаve file"), ("c", "h", "SAVE FILE")], "capture_id string, source_id string, text string")
    got = {(r.source_id, r.label_id) for r in shown_labels(runs, labels, table).collect()}
    assert got == {("a", 1), ("d", 2)}
    assert shown_labels(runs.limit(0), labels, table).count() == 0
    assert [r.f.display for r in normalized(spark.createDataFrame([(None,), ("",), ("ｘ" * 50_000,)], "text string"), "text", table, "f").collect()][2] == "x" * 50_000


def test_tables_of_equal_size_are_two_tables(spark):
    df = spark.createDataFrame([("А",), ("В",)], "t string")
    read = lambda t: {r.t: r.f.look for r in normalized(df, "t", t, "f").collect()}
    assert read({"А": "A"}) == {"А": "A", "В": "В"} and read({"В": "B"}) == {"А": "А", "В": "B"}


def test_no_icu_is_an_error():
    from paneflow.llm import text_forms

    with pytest.raises(RuntimeError):
        text_forms._ask_icu(object())


def test_look_alikes_of_high_planes(table):
    assert table["\U0001d400"] == "A" and table["\U0001d7ce"] == "0" and any(ord(c) > 0x1FFFF for c in table)


# ---- encoding
@pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary here")
@pytest.mark.parametrize("n", [63, 64, 65, 66, 200])
def test_words_at_the_edge_of_the_inner_cuts(n):
    enc = encoder(VOCAB)
    for t in ("xq" * n)[:n], ("Жы" * n)[: n // 2], " " + ("aB9" * n)[:n], "é" * n:
        assert enc.encode(t) == enc.encoding.encode_ordinary(t)


@pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary here")
def test_encoding_equals_the_plain_way(spark):
    enc = encoder(VOCAB)
    r = random.Random(3)
    alpha = [*"ab'sdtlveм Я é1२ \n\t\r\x0b\x1c\u0085\xa0 　!.<|>😀‍—_-=", "<|endoftext|>", "'ll", " re", "  "]
    texts = ["".join(r.choice(alpha) for _ in range(r.randint(0, 80))) for _ in range(2000)] + ["a" * 5000, " " * 3000 + "x", "Ж" * 3000]
    for t in texts:
        ids = enc.encode(t)
        assert ids == enc.encoding.encode_ordinary(t) and enc.decode(ids) == t
    df = spark.createDataFrame([(1, "hello world", "clash"), (2, "", ""), (3, None, ""), (3, None, "")], "doc_id bigint, text string, ids string")
    out = sorted((x.doc_id, list(x.ids)) for x in encode_corpus(df, vocabulary=VOCAB).collect())
    assert out == [(1, enc.encoding.encode_ordinary("hello world")), (2, []), (3, []), (3, [])]


def test_forced_pairs_stand_in_no_token():
    if os.path.exists(VOCAB):
        enc = ForcedBoundaryEncoder(VOCAB)
        for token in list(enc.encoding._mergeable_ranks)[:20_000]:
            assert not any(enc.forced[a, b] for a, b in zip(token, token[1:]))


# ---- leakage
ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"


@pytest.mark.parametrize(
    ("text", "n"),
    [
        (" ".join(ITEM.split()[:14]), 1), (" ".join(ITEM.split()[:13]), 0), (ITEM.upper().replace(" ", ",\n> "), 1), ("x " + ITEM.replace("seven ", "other "), 1), (ITEM.replace("seven ", ""), 1), (ITEM.replace("seven", "seven new"), 1),
        (" ".join(w if k % 4 else "zzz" for k, w in enumerate(ITEM.split())), 0), ("**" + ITEM.replace("ten", "t​en") + "**", 1), ("", 0), (None, 0), ("   ", 0), ("word " * 20_000 + ITEM, 1),
    ],
)
def test_passages(text, n):
    assert len(Matcher([(1, ITEM), (2, "too short"), (3, None)]).passages(text)) == n


def test_longest_passage_with_many_alterations():
    words = [f"w{i}" for i in range(160)]
    text = " ".join("zz" if k % 10 == 5 else w for k, w in enumerate(words))
    ((_, a, b, n, e),) = Matcher([(1, " ".join(words))]).passages(text)
    assert (n, e) == (160, 16) and text[a:b] == text


def test_long_markup_is_no_word():
    tag = '<a href="' + "x" * 500 + '" title="y">'
    assert words_of(f"one {tag}two</a> &#1234567890; three")[0] == ["one", "two", "three"]
    assert words_of("if a <b then three words stay, 5 > 4")[0][-6:] == ["then", "three", "words", "stay", "5", "4"]


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    from paneflow.llm import leakage

    docs = spark.createDataFrame([(1, ITEM), (2, ITEM[::-1] + " " + ITEM)], "doc_id bigint, text string")
    items = spark.createDataFrame([(i, ITEM) for i in range(9)], "item_id bigint, text string")
    whole = sorted(map(tuple, leaks(docs, items).collect()))
    monkeypatch.setattr(leakage, "BLOCK_BYTES", 200)
    assert sorted(map(tuple, leaks(docs, items).collect())) == whole and len(whole) == 18


def brute(item, doc, least=14, one_in=8):
    """Best alignment by plain dynamic programming over all starts; true if a passage counts."""
    a, b = words_of(item)[0], words_of(doc)[0]
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] != b[j]:
                continue
            best = {(i + 1, j + 1): 0}
            todo = [(i + 1, j + 1)]
            while todo:
                x, y = todo.pop()
                e = best[x, y]
                if x - i >= least and e * one_in <= x - i and a[x - 1] == b[y - 1]:
                    return True
                for nx, ny, c in ((x + 1, y + 1, int(x < len(a) and y < len(b) and a[x] != b[y])), (x + 1, y, 1), (x, y + 1, 1)):
                    if nx <= len(a) and ny <= len(b) and e + c <= 4 and best.get((nx, ny), 9) > e + c:
                        best[nx, ny] = e + c
                        todo.append((nx, ny))
    return False


def test_passages_against_brute_force():
    r = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    wrong = 0
    for _ in range(150):
        item = [r.choice(vocab) for _ in range(40)]
        k, n = r.randint(0, 15), r.randint(9, 25)
        part = item[k : k + n]
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(part))
            part = r.choice([part[:at] + ["zz"] + part[at + 1 :], part[:at] + part[at + 1 :], part[:at] + ["zz"] + part[at:]])
        doc = " ".join(["pre"] * 3 + part + ["post"] * 3)
        wrong += brute(" ".join(item), doc) != bool(Matcher([(1, " ".join(item))]).passages(doc))
    assert wrong == 0


def test_leaks_table_and_offsets(spark):
    docs = spark.createDataFrame([(1, "Intro. " + ITEM + " end", "x"), (1, "Intro. " + ITEM + " end", "x"), (2, None, "x"), (3, "nothing", "x")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(9, ITEM), (9, ITEM), (8, None)], "item_id bigint, text string")
    (r,) = leaks(docs, items).collect()
    assert (r.doc_id, r.item_id, r.item_words, r.altered) == (1, 9, 18, 0) and ("Intro. " + ITEM + " end")[r.start : r.end] == ITEM
    assert leaks(docs.limit(0), items).count() == 0 and leaks(docs, items.limit(0)).count() == 0


# ---- languages
EN = "The cat sits on the table and looks at the window of the old house near the river."
DE = "Die Katze sitzt auf dem Tisch und schaut aus dem Fenster des alten Hauses am Fluss."
FR = "Le chat est assis sur la table et regarde par la fenêtre de la vieille maison près de la rivière."


def toy_model():
    pieces = {"en": [EN, "I would like to know why this does not work with the new version of the page."], "de": [DE, "Ich möchte gerne wissen, warum das mit der neuen Version der Seite nicht funktioniert."], "fr": [FR, "Je voudrais savoir pourquoi cela ne marche pas avec la nouvelle version de la page."]}
    wrong = [(DE, "en")] * 2
    return LanguageModel.fit([(s, k) for k, ss in pieces.items() for s in ss for _ in range(8)] + wrong, LanguageSpec(clusters=2))


def test_segments_and_labels(spark):
    m = toy_model()
    text = f"{EN}\n```\nDas ist Code und zählt nicht als Prosa in diesem Text hier oben.\n```\n{DE} `error: unknown flag`\n-- sent from my handheld"
    assert [(s[1], s[3]) for s in segments(text, m)] == [("en", 18), ("de", 16)]
    assert segments(None, m) == [] == segments("  \n", m) == segments("http://example.test/a", m)
    docs = spark.createDataFrame([(1, EN, "en"), (2, EN, "de"), (3, EN, None), (4, EN + "\n" + FR, "en"), (5, None, None), (6, "", "en"), (7, EN, "English"), (8, DE, "xx"), (9, "    if (a) {\n      return b;\n    }", None), (10, FR, "uk")], "doc_id bigint, text string, lang string")
    got = {(r.doc_id, r.lang) for r in wrong_labels(docs, m).collect()}
    assert got == {(2, "en"), (3, "en"), (4, "en"), (4, "fr"), (8, "de"), (10, "fr")}
    assert wrong_labels(docs.limit(0), m).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, EN, None), (2, "", "en"), (3, None, "de")], "doc_id bigint, text string, lang string")
    assert wrong_labels(docs).count() == 0 and wrong_labels(docs.limit(0)).count() == 0


def test_words_and_lines_of_any_length():
    m = toy_model()
    long = "donaudampfschifffahrtsgesellschaftskapitänsmützen"
    assert vector(long, 8192)[1].sum() > 4 * len(long) - 4 and vector("x" * 100_000, 8192)[1].sum() > 390_000
    assert prose_of("a <span class='" + "x" * 200 + "'>b</span> c")[0].split() == ["a", "b", "c"]
    assert prose_of("-- sent from my " + "very " * 30 + "old machine") == [] and prose_of("Edit: typo") == []
    assert prose_of("-- " + EN) == [EN]
    assert [m.classify(x) for x in (EN, DE, FR, "")] == m.classify_all([EN, DE, FR, ""])


def test_label_names(spark):
    rows = [("en_GB", "en"), ("pt-BR", "pt"), ("Deutsch", "de"), ("русский", "ru"), ("N/A", None), ("", None), (None, None), ("xx", None), ("pl", "other"), (" FR ", "fr")]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, a string").select("i", normal_label(F.col("a")).alias("n"))
    assert {r.i: r.n for r in df.collect()} == {i: b for i, (_, b) in enumerate(rows)}


def test_twelve_words_rule():
    assert [x[0] for x in languages_of([(0, "en", 0.9, 20, ""), (1, "de", 0.9, 11, "")])] == ["en"]
    assert [x[0] for x in languages_of([(0, "en", 0.9, 5, ""), (1, "de", 0.9, 6, "")])] == ["de"] and languages_of([]) == []
    assert prose_of("> quoted words stay here") == ["quoted words stay here"]


# ---- personal data
@pytest.fixture(scope="module")
def crf():
    return SkipChainCRF.fit(texts=1200, epochs=6)


def test_held_out_texts(crf):
    right = 0
    for pieces in examples(300, seed=77):
        want = {label for _, label in pieces if label != "O"}
        right += {k for *_, k, _ in spans(Doc(["".join(p for p, _ in pieces)]), crf)} == want
    assert right >= 285


def test_found_and_redacted(spark, crf):
    rows = [(1, "Ship to Anna Feldberg", "Order 261-17-6381 shipped", T0), (2, None, "Write to anna.x@mail.example", T0), (3, "", None, T0), (2, None, "old text", datetime(2024, 1, 1)), (4, "Field Notes", "192.0.2.17", T0)]
    df = spark.createDataFrame(rows, "view_node_id bigint, name string, text string, received_at timestamp")
    got = {(r.view_node_id, r.field): (r.redacted, [f.kind for f in r.found]) for r in find_personal_data(df, crf=crf).collect()}
    assert got[1, "name"] == ("Ship to [PERSON_NAME]", ["person_name"]) and got[1, "text"][1] == [] and got[2, "text"] == ("Write to [EMAIL]", ["email"])
    assert (3, "text") not in got and got[3, "name"] == ("", []) and got[4, "name"][1] == [] and got[4, "text"][1] == []
    assert find_personal_data(df.limit(0), crf=crf).count() == 0


def test_tables_give_the_sums_of_the_features(crf):
    import numpy as np

    docs = [Doc(["".join(p for p, _ in x), "Anna Feldberg\n12 Main Street"]) for x in examples(40, seed=3)] + [Doc(["", "a"])]
    got, starts = crf.node_scores(docs)
    want = np.concatenate([crf.w[d.features()].sum(1) for d in docs])
    assert np.abs(got - want).max() < 1e-4 and len(starts) == len(docs)
    together, alone = crf.marginals_all([*docs, Doc([""])]), [crf.marginals(d) for d in docs]
    assert all(np.allclose(a, b) for a, b in zip(together, alone)) and together[-1].shape == (0, 6)


def test_chain_marginals_against_brute_force(crf):
    import itertools

    import numpy as np

    doc = Doc(["Dr. Feldberg 5"])
    node, k, n = crf.node_scores([doc])[0], 6, len(doc.tokens)
    node[0] += crf.chain[k, :k]
    node[-1] += crf.chain[:k, k]
    c = np.clip(crf.chain[:k, :k].astype(float), -8, 8)
    want = np.zeros((n, k))
    for ys in itertools.product(range(k), repeat=n):
        p = np.exp(sum(node[i, y] for i, y in enumerate(ys)) + sum(c[a, b] for a, b in zip(ys, ys[1:])) - node.max(1).sum())
        for i, y in enumerate(ys):
            want[i, y] += p
    assert np.allclose(crf.marginals(doc), want / want.sum(1, keepdims=True))


def test_skip_edges_and_long_texts(crf):
    doc = Doc(["Guest Anna Feldberg\n" + "word " * 3000 + "\nFeldberg"])
    assert len(doc.skips()) == 1 and crf.marginals(doc).shape == (len(doc.tokens), 6) and Doc([""]).skips() == []


# ---- linkage
def test_label_model_learns_accuracies():
    import numpy as np

    r = np.random.default_rng(1)
    y = r.random(4000) < 0.4
    votes = np.stack([np.where(r.random(4000) < acc, np.where(y, 1, -1), np.where(y, -1, 1)) for acc in (0.95, 0.85, 0.7)], 1)
    pats, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p = LabelModel(((0,), (1,), (2,))).fit(pats, counts)
    assert ((p[back.ravel()] > 0.5) == y).mean() > 0.93


def test_link_small_page(spark):
    rect = "struct<x:double,y:double,width:double,height:double>"
    caps = spark.createDataFrame([("c", (800.0, 600.0, 2.0, 0.0, 100.0), [("main", None, None, None)], T0)], "capture_id string, viewport struct<width_css_px:double,height_css_px:double,device_scale_factor:double,scroll_x_css_px:double,scroll_y_css_px:double>, frames array<struct<frame_id:string,parent_frame_id:string,url:string,transform_to_parent:array<double>>>, received_at timestamp")
    n = 30
    dom = [("c", "main", i, f"d{i}", "root", "button", "button", {"aria-label": f"Button number {i}"}, (20.0, 20.0 + 60 * i, 120.0, 40.0), i != 3, T0) for i in range(n)] + [("c", "main", 99, "wrap", "root", None, "div", {}, (19.0, 19.0, 122.0, 42.0), True, T0), ("c", "main", 100, "child", "wrap", None, "span", {}, None, True, T0)]
    dom = spark.createDataFrame(dom, f"capture_id string, frame_id string, ord int, source_id string, parent_source_id string, role string, tag string, attributes map<string,string>, bounds {rect}, visible boolean, received_at timestamp")
    ax = spark.createDataFrame([], "capture_id string, source_id string, role string, name string, backend_dom_source_id string, received_at timestamp")
    runs = spark.createDataFrame([], f"capture_id string, frame_id string, source_id string, text string, dom_source_id string, bounds {rect}, received_at timestamp")
    items = [("c", f"v{i}", "vision_parser", (2 * 22.0, 2 * (22.0 + 60 * i - 100), 2 * 118.0, 2 * 39.0), "btn", f"Button nunber {i}", 0.9, "p", T0) for i in range(n)] + [("c", "far", "vision_parser", (1400.0, 50.0, 30.0, 10.0), None, "99+", 0.5, "p", T0), ("c", "flat", "ocr", (0.0, 0.0, 0.0, 5.0), None, "x", 0.5, "p", T0)]
    items = spark.createDataFrame(items, f"capture_id string, source_id string, kind string, rect_image_px {rect}, class string, text string, confidence double, provider string, received_at timestamp")
    got = {(r.item_source_id, r.dom_source_id) for r in link(items.unionByName(items), dom, ax, runs, caps).collect()}
    assert got == {(f"v{i}", f"d{i}") for i in range(n) if i != 3}
    assert link(items.limit(0), dom, ax, runs, caps).count() == 0
