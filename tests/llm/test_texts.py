import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import rows
from tidemark.llm import packing, personal, truncation
from tidemark.llm.encode import VOCABULARY, encode_corpus, encoder

DOCS = "doc_id bigint, text string, source string, key string, ids string"


def docs(spark, data):
    return spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in data], DOCS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abqxzlvetdm 's're!?.\n\t12é日本🙂 ​́\x00\u3000'")), max_size=120), max_size=4))
def test_fragments_encode_as_the_whole(texts):
    own = encoder(VOCABULARY)
    for text in texts:
        assert "".join(own.fragments(text)) == text
        assert [i for f in own.fragments(text) for i in own.encode(f)] == own.encode(text)
    assert own.batch(pa.array([*texts, None], pa.string())).to_pylist() == [own.encode(t) for t in texts] + [[]]
    assert own.batch(pa.array(["ab cd", *texts], pa.string()).slice(1)).to_pylist() == [own.encode(t) for t in texts]


def test_cuts_across_windows(monkeypatch):
    from tidemark.llm import encode

    own, text = encoder(VOCABULARY), "some words 1234567 é é qxqxqx zqjx\n" * 40
    whole = own.fragments(text)
    for size in (1, 2, 7):
        monkeypatch.setattr(encode, "WINDOW_BYTES", size)
        assert own.fragments(text) == whole
    assert len(whole) > 200


def test_encode_corpus(spark):
    import tokenizers

    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = ["plain words", None, "", "   ", "<|endoftext|> x", "word " * 30_000, "x" * 50_000, "日本語テキスト" * 3000, "plain words"]
    data = [(i, x, "s") for i, x in enumerate(texts)]
    want = {i: t.encode(x or "", add_special_tokens=False).ids for i, x, _ in data}
    got = {r["doc_id"]: r["ids"] for r in encode_corpus(docs(spark, data)).collect()}
    assert got == want
    assert encode_corpus(docs(spark, [])).collect() == []
    # rows of one key stay rows of their own, also very long ones
    twice = encode_corpus(docs(spark, [(1, "ab " * 1_700_000, "s"), (1, "cd " * 1_700_000, "s"), (None, "ab", "s")])).select("doc_id", "n_tokens").collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in twice) == [(0, 1), (1, 1_700_001), (1, 1_700_001)]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=14), st.integers(40, 70))
def test_fill_keeps_capacity_and_all_items(sizes, capacity):
    plan, used = packing.fill(sizes, capacity)
    load = [0] * used
    for size, segments in plan.items():
        assert sum(s.count for s in segments) == sizes[size]
        for s in segments:
            for k in range(s.count):
                load[s.container + k // s.each] += size
    assert all(0 < x <= capacity for x in load)


def test_bucket_bounds_are_optimal():
    rng = random.Random(4)

    def padding(h, bounds):
        return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in h.items())

    def brute(h, k):
        lengths = sorted(h)
        best = {0: 0}
        for _ in range(k):
            best = {j: min(best[i] + sum(h[x] * (lengths[j - 1] - x) for x in lengths[i:j]) for i in best if i < j) for j in range(1, len(lengths) + 1) if any(i < j for i in best)} | {0: 0}
        return best[len(lengths)]

    for _ in range(50):
        h = {rng.randint(1, 60): rng.randint(1, 9) for _ in range(12)}
        bounds = packing.bucket_bounds(h, rng.randint(1, 8))
        assert max(bounds) == max(h)
        assert padding(h, bounds) <= brute(h, len(bounds))


def test_packing(spark):
    rng = random.Random(1)
    sizes = [(i, rng.choice([0, 1, 5, 17, 60, 99, 100, 101, 250, 400])) for i in range(400)]
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint")
    windows = spark.createDataFrame([(1, "a", 100), (2, "b", 300), (3, "c", 0), (None, "d", 5)], "window_id int, client_id string, capacity_tokens int")
    for salt, buckets in ((200_000, 512), (7, 3)):
        packing.ITEMS_PER_SALT = salt
        got = packing.pack_sizes(df, windows, buckets).collect()
        for window, capacity in ((1, 100), (2, 300)):
            mine = [r for r in got if r["window_id"] == window]
            load, total = {}, {}
            for r in mine:
                load[r["prompt_id"]] = load.get(r["prompt_id"], 0) + r["n_tokens"]
                total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
                assert r["n_tokens"] <= capacity
            assert total == dict(sizes)
            assert max(load.values()) <= capacity
            for doc, n in sizes:
                assert sum(r["doc_id"] == doc for r in mine) == max(1, -(-n // capacity))
        assert {r["window_id"] for r in got} == {1, 2}
    packing.ITEMS_PER_SALT = 200_000
    assert packing.pack_sizes(df.limit(0), windows).collect() == []
    assert packing.pack_sizes(df, windows.limit(0)).collect() == []


def test_personal_information(spark):
    known = spark.createDataFrame([(1, "Elif", "given"), (2, "Zarnholt", "family"), (3, "Will", "given")], "name_id int, name_text string, name_kind string")
    texts = [
        (1, "Elif Zarnholt will retry at 10"),
        (2, "mail elif.zarnholt@fernpost.example or call (623) 555-0194"),
        (3, "lot 528-467-2596 of 20, SKU 7789-28-293, part no. 338-30-6311, git@code.example.test:a/b"),
        (4, "SSN 000-21-0662 lives at 49 BRAMBLECROFT RD APT 19"),
        (5, "rui [at] fernpost [dot] example, Calle del Candil 11, 4º C, Haselnussstr. 21"),
        (6, "Hi Will, done. will retry, will wait, will stop"),
        (7, "@elif_z see https://x.test/elif and elif@2x.png"),
        (8, None),
        (9, ""),
        (10, "lane 5 of 14 main street mode, 86 Road tests failed, epoch 1404196592, 03.05.2025 14:59"),
        (11, "Elif Zarnholt and Elif Zarnholt, will see, will do"),
        (11, "Elif Zarnholt and Elif Zarnholt, will see, will do"),
    ]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in texts], "id bigint, text string, tbl string, kind string")
    got = set(rows(personal.personal_kinds({"t": (df, "id", "text")}, known)))
    assert got == {("t", 1, "person"), ("t", 2, "email"), ("t", 2, "phone"), ("t", 4, "id_number"), ("t", 4, "address"), ("t", 5, "email"), ("t", 5, "address"), ("t", 6, "person"), ("t", 11, "person")}
    clean = {r["rec_id"]: r["text"] for r in personal.redacted_texts({"t": (df, "id", "text")}, known).collect()}
    assert clean[1] == "[PERSON] will retry at 10"
    assert clean[2] == "mail [EMAIL] or call [PHONE]"
    assert clean[3] == texts[2][1]
    assert clean[6].startswith("Hi [PERSON], done. will")
    empty = df.limit(0)
    assert rows(personal.personal_kinds({"t": (empty, "id", "text")}, known)) == []
    assert rows(personal.personal_kinds({"t": (df, "id", "text")}, known.limit(0))) != []


def test_truncation(spark):
    nouns = [f"thing{chr(97 + n)}" for n in range(20)]
    rng = random.Random(0)
    sentence = lambda: f"The {rng.choice(nouns)} stays open until the {rng.choice(nouns)} is closed."
    whole = [" ".join(sentence() for _ in range(8)) for _ in range(120)]
    data = [(i, t, "feed") for i, t in enumerate(whole)]
    body = whole[5]
    data += [(500, body[: body.rindex(" until")] + " until the", "feed"), (501, whole[6][:-12] + " [truncated]", "feed"), (502, '{"a": [1, 2, {"b": "c', "feed"), (503, '{"a": [1, 2]}', "feed"), (504, whole[7][:-1], "feed"), (505, None, "feed"), (506, " ", "feed"), (507, whole[8] + "...", "feed"), (508, "a\tb\nc\td\ne", "feed"), (None, "x", "feed"), (509, "x", None)]
    got = {r[0] for r in truncation.truncated(docs(spark, data)).collect()}
    assert {500, 501, 502, 508} <= got
    assert not got & ({503, 504, 505, 506, 507} | set(range(120)))
    shares = {r["source"]: r for r in truncation.truncation_by_source(docs(spark, data)).collect()}
    assert shares["feed"]["n_cut"] == len({d for d in got if d != 509})
    assert truncation.truncated(docs(spark, [])).collect() == []


def test_early_end_of_a_near_copy(spark):
    words = [f"word{n}" for n in range(60)]
    text = " ".join(words[:30]) + ". " + " ".join(words[30:]) + "."
    data = [(1, text, "a"), (2, text[: text.index("word56") + 4], "b"), (3, text[: text.index("word56") + 4], "c")]
    got = {r["doc_id"]: r["early"] for r in truncation.endings(docs(spark, data)).collect()}
    assert got == {1: False, 2: True, 3: True}


def test_early_end_beside_a_longer_text_of_the_bucket(spark):
    words = [f"word{n}" for n in range(60)]
    text = " ".join(words[:30]) + ". " + " ".join(words[30:]) + "."
    cut = text[: text.index("word56") + 4]
    other = cut.replace("word55 word", "word55. Other tail here") + " more words follow after."
    data = [(1, text, "a"), (2, cut, "b"), (3, other, "c"), (4, text.replace("word56", "closed. And"), "d")]
    for block in (256, 1):
        truncation.BLOCK_TEXTS = block
        got = {r["doc_id"]: r["early"] for r in truncation.endings(docs(spark, data)).collect()}
        assert got == {1: False, 2: True, 3: False, 4: False}
    truncation.BLOCK_TEXTS = 256


def test_every_span_is_blanked_out_for_later_patterns():
    for line, kind in (("passport 123 456 7890\n", "id_number"), ("49 Bramblecroft Road\n", "address")):
        spans, rest = personal.structured(line * 60)
        assert [k for *_, k in spans] == [kind] * 60
        assert all(set(rest[b:e]) == {"\x00"} for b, e, _ in spans)
        assert not any(term[2].lower().startswith("bramble") for term in personal.name_terms(rest))


def test_spelt_out_addresses_with_blanks():
    for text in ("write to jane [ at ] fernpost.example today", "write to jane ( at ) fernpost.example today", "write to jane at fernpost\tdot\texample today", "write to jane at fernpost\u00a0dot\u00a0example today"):
        assert [k for *_, k in personal.structured(text)[0]] == ["email"]


def test_words_of_unpointed_lines_are_whole_words(spark):
    said = " ".join(["so we went on and on about the marquee thing"] * 4)
    data = [(1, said, "voice"), (2, "Please bring the marquee", "mail"), (3, "Please bring the marq", "mail")]
    got = {r["doc_id"]: r["mid_word"] for r in truncation.endings(docs(spark, data)).collect()}
    assert (got[2], got[3]) == (False, True)


def test_recall_of_copies_cut_anywhere(spark):
    rng = random.Random(11)
    words = [f"word{n}" for n in range(3000)]
    data, cut = [], set()
    for n in range(120):
        text = [rng.choice(words) for _ in range(rng.randrange(60, 200))]
        for at in range(9, len(text) - 1, 10):
            text[at] += "."
        data.append((n, " ".join(text) + ".", "whole"))
        # a copy with a word in fifty changed, cut in mid sentence after a third to all but a few of its words
        share = len(text) * rng.uniform(0.33, 0.95)
        size = max(20, int(share) // 10 * 10 + rng.randrange(2, 8))
        part = text[: min(size, len(text) - 2)]
        copy = [w if rng.random() > 0.02 else "other" for w in part]
        runs = lambda x: {tuple(x[k : k + 5]) for k in range(len(x) - 4)}
        if not part[-1].endswith(".") and len(runs(copy) & runs(text)) >= 0.8 * len(runs(copy)):
            data.append((1000 + n, " ".join(copy), "cut"))
            cut.add(1000 + n)
    for n in range(30):  # longer texts that begin like one of them
        data.append((5000 + n, data[0][1] + " " + " ".join(rng.choice(words) for _ in range(30)) + ".", "longer"))
    got = {r["doc_id"] for r in truncation.endings(docs(spark, data)).where("early").select("doc_id").collect()}
    assert not got - cut
    assert len(cut) > 80
    assert len(got) >= 0.9 * len(cut)


def test_marks_and_signs_at_the_end_of_any_length():
    end = lambda text: {k for k, v in truncation.ending(text)[0].items() if v}
    assert "marked" in end("so it goes [truncated]") and "marked" in end("so it goes [" + " " * 5000 + "truncated" + " " * 5000 + "]")
    assert "marked" in end("so it goes (text continued ...)") and "marked" not in end("so (it) goes.")
    assert "dots" in end("and then...") and "dots" in end("and then …") and "dots" not in end("and then..")
    assert "code_after" in end("It is done. " + "X" * 4000 + " " + "Y_" * 3000)
    assert "closed" in end("It is done." + ")" * 3000)
