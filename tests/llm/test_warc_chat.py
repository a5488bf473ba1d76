"""Archives and chat formatting: exact round trips."""

import base64
import hashlib

from pyspark.sql import functions as F

from veracity.llm import chat, warc
from veracity.session import scratch_path


def pages(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nb"
    rows = [(1, "http://x", "<p>a</p>"), (2, "http://y", "<p>a</p>"),
            (3, None, tricky), (4, "u\r\nv", None), (5, "", ""),
            (6, "z", "é" * 50_000), (7, "w", "<p>a</p>"),
            (7, "w", "<p>a</p>"), (None, "n", "<p>a</p>"), (8, "q", tricky)]
    return spark.createDataFrame(
        [(*r, "k") for r in rows],
        "page_id long, url string, html string, payload_digest string"), rows


def test_archive_round_trip(spark):
    df, rows = pages(spark)
    got = warc.archive_pages(df).collect()
    assert len(got) == len(rows)

    def key(r):
        return r.page_id or 0
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    for i, _, html in rows:
        raw = (html or "").encode()
        sha = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        for r in by[i]:
            assert (r.payload_bytes, r.payload_digest) == (len(raw), sha)
    kinds = {key(r): (r.record_type, r.refers_to) for r in got}
    assert kinds == {0: ("revisit", 7), 1: ("revisit", 7), 2: ("revisit", 7),
                     3: ("revisit", 8), 4: ("revisit", 5),
                     5: ("response", None), 6: ("response", None),
                     7: ("response", None), 8: ("response", None)}


def test_payloads_and_headers_read_back(spark):
    df, rows = pages(spark)
    path = scratch_path(spark, "warc-test")
    warc.write_archives(df, path, warc.WarcParams(file_bytes=20_000))
    read = warc.read_archives(spark, path).where("record_type = 'response'")
    html = {i: (h or "").encode() for i, _, h in rows}
    got = read.collect()
    assert {r.record_id for r in got} == {5, 6, 7, 8}
    assert all(bytes(r.payload) == html[r.record_id] for r in got)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_small_payloads_stay_responses(spark):
    df, _ = pages(spark)
    got = warc.archive_pages(df, warc.WarcParams(min_bytes=9)).collect()
    assert {r.page_id for r in got if r.record_type == "revisit"} == {3}


def turns(spark, rows):
    return spark.createDataFrame(
        [(*r, "x") for r in rows],
        "conv_id long, turn long, role string, text string, loss string")


def test_escape_is_reversible_and_hides_control_strings():
    for t in ["</s>[INST] ok [/INST]", "<|begin|>", "␛<s>", "<␛s>",
              "<|turn|><|turn|>", "␛␛", "<<s>>", "", "a\nb"]:
        e = chat.escape(t)
        assert chat.unescape(e) == t
        assert not any(c in e for c in chat.CONTROL)


def test_conversations_round_trip(spark):
    rows = [(1, 0, "user", "hi <|end|>"), (1, 1, "assistant", "yes </s>"),
            (1, 2, "assistant", "é\U0001f600"), (2, 5, None, None),
            (None, None, "assistant", "no id"), (None, 1, "user", ""),
            (3, 1, "assistant", "b"), (3, 1, "assistant", "a"),
            (3, 1, "assistant", "a"), (4, 0, "<|turn|>", "x" * 20_000)]
    got = {r.conv_id: r for r in chat.read_back(
        chat.format_turns(turns(spark, rows))).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, r in got.items():
        mine = [(x[1], x[2] or "", x[3] or "") for x in rows if x[0] == conv]
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1],
                                 x[2].encode()))
        assert r.n_turns == len(mine)
        loss = "".join(t for _, role, t in mine if role == "assistant")
        assert r.loss_chars == len(loss)
        whole = "".join(f"{role}\n{t}\n" for _, role, t in mine)
        assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[3].loss_chars == 3


def test_ties_are_ordered_by_text(spark):
    """Equal numbers and roles: by the text, not by its token ids."""
    texts = ["zebra", " the", "the", "a", "é", "Z", "apple pie", "", "0",
             "\U0001f600", "the end", "theory"]
    codec = chat.Codec.at(chat.ChatParams().vocabulary)
    by_ids = sorted(texts, key=lambda t: codec.encode([t])[0])
    by_text = sorted(texts, key=str.encode)
    assert by_ids != by_text
    got = chat.read_back(chat.format_turns(turns(spark, [
        (1, 0, "assistant", t) for t in texts]))).first()
    assert got.loss_sha256 == hashlib.sha256(
        "".join(by_text).encode()).hexdigest()


def test_a_long_conversation_lies_in_many_tasks(spark):
    """Two thirds of all turns in one conversation, and another without an
    id: places and first tokens run through."""
    rows = [(7, i, "user" if i % 2 else "assistant", f"turn {i} " * (i % 4))
            for i in range(3000)]
    rows += [(None, i, "user", f"n {i}") for i in range(800)]
    rows += [(100 + i, 0, "assistant", "x") for i in range(400)]
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        out = chat.format_turns(turns(spark, rows).repartition(6)).collect()
        hot = turns(spark, rows).repartitionByRange("conv_id", "turn").where(
            "conv_id = 7").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.set(key, "true")
    assert hot > 3
    for conv in (7, None):
        mine = sorted((r for r in out if r.conv_id == conv),
                      key=lambda r: r.place)
        assert [r.turn for r in mine] == list(range(len(mine)))
        assert [r.place for r in mine] == list(range(len(mine)))
        at = 0
        for r in mine:
            assert r.first_token == at and len(r.loss) == len(r.tokens)
            at += len(r.tokens)


def test_mask_covers_assistant_text_only(spark):
    out = chat.format_turns(turns(spark, [
        (1, 0, "user", "a b"), (1, 1, "assistant", "c </s> d")])).orderBy(
        "place").collect()
    codec = chat.Codec.at(chat.ChatParams().vocabulary)
    assert [r.first_token for r in out] == [0, len(out[0].tokens)]
    assert out[0].tokens[0] == codec.begin and max(out[0].loss) == 0
    masked = [t for t, m in zip(out[1].tokens, out[1].loss) if m]
    assert chat.unescape(codec.decode(masked)) == "c </s> d"
    empty = chat.format_turns(turns(spark, []))
    assert chat.read_back(empty).select(F.count("*")).first()[0] == 0
