"""Chat formatting, token counts, decontamination and WARC against plain Python on small tables."""

import base64
import gzip
import hashlib
import json

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lumisift.llm import chat, decontaminate, tokens, warc

BPE = public_tokenizers.path("byte_bpe_50k.json")


# chat
ODD = ["</s>[INST] ok [/INST]", "[\\INST] <\\\\s> [", "", None, "[ROLE x]y[/ROLE]<s>", "\\", "a\nb", "<", "/s>", "日本[/SYS]"]


def test_chat_round_trip(spark):
    rows = [(1, i, role, t, 9) for i, (role, t) in enumerate(
        [(r, t) for t in ODD for r in ("user", "assistant", "system", "tool]%5D[", None)])]
    rows += [(2, None, "user", "x", 0), (2, 0, "assistant", "y", 0), (2, 0, "assistant", "y", 0), (None, 0, "user", "z", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    out = {r.conv_id: r for r in chat.read_chats(chat.format_chats(chat.turns(df))).withColumn("loss", chat.loss_text()).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [(r[2] or "", r[3] or "") for r in rows[:50]]
    assert out[1].loss == "".join(r[3] or "" for r in rows[:50] if r[2] == "assistant")
    assert [(t.role, t.text) for t in out[2].turns] == [("user", "x"), ("assistant", "y"), ("assistant", "y")]
    assert out[None].formatted == "<s>[INST]z[/INST]"
    assert chat.turns(df.limit(0)).count() == 0


def test_chat_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]},
        {"instruction": "do", "output": "done"}, {"instruction": "do", "input": "it", "output": "done"},
        {"system": "s", "prompt": "p", "completion": "c"}, {"other": 1},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(6, "{broken"), (7, None)]
    got = chat.turns_from_json(spark.createDataFrame(rows, "conv_id long, record string")).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.conv_id, r.turn or 0)):
        by.setdefault(r.conv_id, []).append((r.role, r.text))
    assert by[0] == [("user", "a"), ("assistant", "")] and by[1] == [("user", "q"), ("assistant", "r")]
    assert by[2] == [("user", "do"), ("assistant", "done")] and by[3][1] == ("user", "it") and by[4][0] == ("system", "s")
    assert by[5] == by[6] == by[7] == [(None, None)]
    typed = spark.createDataFrame([(1, [("user", "a")])], "conv_id long, messages array<struct<role:string,content:string>>")
    assert [(r.role, r.text) for r in chat.turns(typed).collect()] == [("user", "a")]
    with pytest.raises(ValueError):
        chat.turns(spark.range(1))


# tokens
def test_pieces_count_like_the_library():
    import random

    import pyarrow as pa

    tokenizer = tokens._load(BPE)
    pieces = tokens._Pieces(tokenizer)
    rng = random.Random(8)
    parts = list("abZé×÷ÿɏɐ.,'!#$()-1 \n\t\x00\r<|>") + ["<|endoftext|>", "'s", "'ll", "日", "\u2003", "\x85", "\u180e", "\u0301", "  ", "\n\n", " the", "ing.", "🎉"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 25))) for _ in range(4000)]
    texts += ["".join(rng.choices(["a", "Bé", ".", ", ", " ", "\n", "word", "'t"], k=rng.randrange(0, 40))) for _ in range(4000)]
    whole = [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    for low, high in ((0, 3000), (3000, 8000), (0, 8000)):
        assert pieces.count(pa.array(texts[low:high])).tolist() == whole[low:high]
    assert pieces.count(pa.array([], pa.string())).tolist() == []


def test_token_counts(spark):
    words = "plain words don't  stop\n\n<|endoftext|> and 12345, naïve 日本語 🎉 "
    texts = [None, "", " ", words, words * 40, "x" * 3000, " " * 900 + "a", "a<|endoftext|>" * 90, "\n \n" * 300, "é" * 700 + " b"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, words, 2)], "doc_id long, text string, n_bytes int")
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in tokens.token_counts(df, BPE, chunk=256, overlap=80).collect())
    plain = tokens._load(BPE)
    want = sorted((i, len((t or "").encode()), len(plain.encode(t or "", add_special_tokens=False).ids))
                  for i, t in [*enumerate(texts), (3, words)])
    assert got == want
    assert tokens.token_counts(df.limit(0), BPE).count() == 0


def test_token_counts_by_piece(spark):
    words = "plain words don't  stop\n\n<|endoftext|> and 12345, naïve 日本語 🎉 x\u180e y\x85 z\xa0 q\x1f r 's <|endoftext|> "
    texts = [None, "", " ", words, words * 40, "x" * 3000, " " * 900 + "a", "a<|endoftext|> b" * 90, "\n \n" * 300, "é ü" * 700]
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts + real)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(df, BPE, by_piece=True).collect()}
    plain = tokens._load(BPE)
    assert got == {i: len(plain.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts + real)}
    assert tokens._cuts_at_blanks(BPE)


# decontamination
def _brute(docs, items, width):
    out = {}
    windows = [(i, w) for i, t in items for w in decontaminate.windows_of(decontaminate.normalise(t), width)]
    for d, t in docs:
        words, hit, met = decontaminate.normalise(t), set(), set()
        for i, w in windows:
            n = w.count(b" ") + 1
            for p in range(len(words) - n + 1):
                if b" ".join(words[p:p + n]) == w:
                    hit.update(range(p, p + n))
                    met.add(str(i))
        out[d] = (len(words), len(hit), sorted(met))
    return out


@pytest.mark.parametrize("limit", [1 << 20, 40])
def test_decontaminate(spark, limit):
    items = [(10, "a b c d"), (9, "B c"), (8, "É x y z w"), (7, None), (6, "..."), (5, "a b c d"), (None, "q")]
    docs = [(1, "A, b! C d e a b c d"), (2, None), (3, ""), (4, "é x y z w " * 50), (5, "b-c bc"), (6, "Éx y z w")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, items int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in
           decontaminate.scan_documents(d, b, width=3, automaton_chars=limit).collect()}
    assert got == _brute(docs, [x for x in items if x[0] is not None], 3)
    spans = {r.doc_id: r.spans for r in decontaminate.scan_documents(d, b, width=3).collect()}
    assert docs[0][1].encode()[spans[1][0][0]:spans[1][0][1]] == b"A, b! C d"
    assert sorted(r.doc_id for r in decontaminate.clean_documents(d, b, width=3).collect()) == [2, 3]
    assert decontaminate.scan_documents(d, b.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.scan_documents(d.limit(0), b).count() == 0


def test_decontaminate_rows_do_not_depend_on_blocks(spark):
    items = [(10, "a b c d"), (10, "b c d e"), (10, "a b c d"), (9, "x y z"), (None, "q r s"), (None, "t u v"), (8, "d e f")]
    docs = [(1, "a b c d e f"), (1, "x y z"), (1, "nothing"), (None, "q r s t u v"), (None, "x y z"), (None, None), (2, "a b c d e f"),
            (2, "a b c d e f")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted([(1, 6, 6, ["10", "8"], [[0, 11]]), (1, 3, 3, ["9"], [[0, 5]]), (1, 1, 0, [], []), (0, 6, 6, [], [[0, 11]]),
                   (0, 3, 3, ["9"], [[0, 5]]), (0, 0, 0, [], []), (2, 6, 6, ["10", "8"], [[0, 11]]), (2, 6, 6, ["10", "8"], [[0, 11]])])
    for limit in (1 << 20, 120):
        assert len(list(decontaminate._benchmark_blocks(b, "item_id", "text", 3, limit))) == (1 if limit > 120 else 3)
        got = decontaminate.scan_documents(d, b, width=3, automaton_chars=limit).collect()
        assert sorted((r.doc_id or 0, r.n_words, r.n_hit, list(r["items"]), r.spans) for r in got) == want
        assert [r.text for r in decontaminate.clean_documents(d, b, width=3, automaton_chars=limit).collect()] == ["nothing", None]


# WARC
def test_warc_round_trip(spark):
    pages = [(1, "http://a b\r\n", "x"), (5, None, "x"), (3, "u", None), (4, "u", ""), (7, "u", "WARC/1.1\r\n\r\n\r\n"), (5, "v", "x"),
             (9, "u", "é" * 5000)]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, digest string")
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect())
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    last = {"x": 5, "": 4, pages[4][2]: 7, pages[6][2]: 9}
    want = sorted((i, len((t or "").encode()), digest(t), "response" if last[t or ""] == i else "revisit",
                   None if last[t or ""] == i else last[t or ""]) for i, _, t in pages)
    assert got == want
    assert warc.round_trip(df.limit(0)).count() == 0
    kinds = [r.record_type for r in warc.round_trip(df, min_bytes=2).collect()]
    assert kinds.count("revisit") == 0


def _record(i, body=b"hello"):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    sum_ = base64.b32encode(hashlib.sha1(body).digest()).decode()
    return (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Payload-Digest: sha1:{sum_}\r\n"
            f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("pack", [bytes, gzip.compress])
def test_salvage(pack):
    good = [pack(_record(i)) for i in range(5)]
    ids = lambda data: [warc._id(f["warc-record-id"]) for f, _ in warc.salvage(data)[0]]
    assert ids(b"".join(good)) == [0, 1, 2, 3, 4] and warc.salvage(b"".join(good))[1] == []
    broken = bytearray(good[1])
    broken[-12] ^= 0x55
    data = good[0] + bytes(broken) + good[2] + b"junk" * 9 + good[3] + good[4][:-9]
    records, gaps = warc.salvage(bytes(data))
    assert [warc._id(f["warc-record-id"]) for f, _ in records] == [0, 2, 3]
    assert len(gaps) == 3 and sum(g[1] for g in gaps if g[2].startswith("no ")) == 36
    assert warc.salvage(b"") == ([], [])
    assert warc.salvage(pack(_record(1).replace(b"Content-Length: ", b"Content-Length: x")) + good[2])[0][0][0]["warc-record-id"] == "<urn:page:2>"


def test_layouts_beside_other_columns(spark):
    rows = [(1, 0, "user", "a", "p", "s"), (1, 1, "assistant", "b", "p", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt string, system string")
    assert sorted((r.turn, r.role, r.text) for r in chat.turns(df).collect()) == [(0, "user", "a"), (1, "assistant", "b")]
    both = df.withColumns({"completion": F.lit("c"), "messages": F.lit("no list")})
    assert chat.choose_layout(both.schema).name == "turn_rows"
    assert chat.choose_layout(both.drop("turn").schema).name == "system_prompt"
    with pytest.raises(ValueError):
        chat.choose_layout(df.select("conv_id", "turn", "prompt").schema)


def _archived(i: int, body: bytes) -> bytes:
    sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
    head = (f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Payload-Digest: sha1:{sha}\r\n"
            f"Content-Length: {len(body) + 19}\r\n\r\n").encode()
    return head + b"HTTP/1.1 200 OK\r\n\r\n" + body + b"\r\n\r\n"


def test_salvage_is_linear_and_keeps_what_stands_in_front_of_a_cut():
    import random
    import time

    rng = random.Random(1)
    bodies = [rng.randbytes(3000) for _ in range(1500)]
    start = time.time()
    records, gaps = warc.salvage(b"".join(gzip.compress(_archived(i, b)) for i, b in enumerate(bodies)))
    assert [p for _, p in records] == bodies and not gaps and time.time() - start < 5
    whole = gzip.compress(b"".join(_archived(i, b) for i, b in enumerate(bodies[:60])))
    cut, gaps = warc.salvage(whole[:len(whole) // 2] + gzip.compress(_archived(99, b"last")))
    assert 20 < len(cut) < 40 and [p for _, p in cut[:-1]] == bodies[:len(cut) - 1] and cut[-1][1] == b"last"
    assert len(gaps) == 1 and gaps[0][0] == 0
