import base64
import hashlib
import io

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.llm import chat, warc
from sedimenta.llm.queries import ESCAPES

BIG = "<p>" + "long html " * 120_000
PAGES = [(1, "http://a/1", "<p>same</p>", 0), (2, None, "<p>same</p>", 0), (2, None, "<p>same</p>", 0), (3, "http://a/3", None, 0), (4, "http://a/4", "", 0), (5, "x\r\ny", BIG, 0), (None, "http://a/0", "<p>same</p>", 0), (7, "u", "é\r\n\r\nWARC/1.1", 0)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string, size int")


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_archives(pages):
    got = sorted(map(tuple, warc.archive_round_trip(pages).collect()), key=str)
    top = {"<p>same</p>": 2, "": 4, BIG: 5, PAGES[-1][2]: 7}
    want = []
    for i, _, h, _ in PAGES:
        h = h or ""
        again = i is not None and i != top[h]
        want.append((i, len(h.encode()), digest(h.encode()), "revisit" if again else "response", top[h] if again else None))
    assert got == sorted(want, key=str)
    assert warc.archive_round_trip(pages.where("false")).count() == 0


def test_small_payloads_are_responses(pages):
    got = warc.archive_round_trip(pages, min_bytes=1000).collect()
    assert {r.record_type for r in got} == {"response"}


def test_chunk_table(pages, tmp_path):
    folder = f"file://{tmp_path}/w"
    warc.write_archives(warc.decided_chunks(pages, chunk=1000), folder, file_bytes=10)
    rows = warc.read_chunks(pages.sparkSession, folder).where("record_id = 5").orderBy("chunk_no").collect()
    assert len(rows) > 4 and [r.chunk_no for r in rows] == list(range(len(rows)))
    sha, size = hashlib.sha1(), 0
    for r in rows:
        sha.update(r.data)
        size += len(r.data)
        assert (r.bytes_so_far, r.sha1_so_far, r.last) == (size, base64.b32encode(sha.digest()).decode(), r is rows[-1])
    assert b"".join(bytes(r.data) for r in rows) == BIG.encode()


def test_record_ids_are_unique(pages, spark, tmp_path):
    """Rows that repeat an id, with other payloads or the same one, and null ids; a revisit names its response's record."""
    more = spark.createDataFrame([(2, "u", "other", 0), (2, "u", "other", 0), (None, None, None, 0)], pages.schema)
    warc.write_archives(warc.decided_chunks(pages.unionByName(more)), f"file://{tmp_path}/w")
    kinds, refers = {}, set()
    for path in (tmp_path / "w" / "archives").iterdir():
        for fields, pieces in warc.Reader(path.open("rb")).records():
            assert kinds.setdefault(fields["WARC-Record-ID"], fields["WARC-Type"]) == fields["WARC-Type"]
            refers.add(fields.get("WARC-Refers-To"))
            list(pieces)
    assert len(kinds) == len(PAGES) + 3
    assert {kinds[r] for r in refers - {None}} == {"response"}


def test_reader_finds_damage():
    out = io.BytesIO()
    w = warc.Writer(out)
    w.begin(1, "u", "response", None, hashlib.sha1(b"abc").digest(), 3)
    w.data(b"abd")
    w.end()
    fields, pieces = next(warc.Reader(io.BytesIO(out.getvalue())).records())
    with pytest.raises(ValueError, match="digest"):
        list(warc._rows(fields, pieces, True))


TURNS = [(1, 1, "assistant", "two"), (1, 0, "user", "one"), (2, 0, "user", None), (2, 0, "assistant", "tie"), (2, None, None, "first"), (None, 3, "assistant", "no id"), (-7, 0, "user", ESCAPES), (-7, 1, "assistant", ESCAPES), (9, 0, "assistant", "x<y \\ </turn>\n<turn user>" * 50_000), (1, 1, "assistant", "two")]


def test_chat_digests(spark):
    rows = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat.format_turns(chat.canonical_turns(rows))
    for r in formatted.collect():
        assert "</turn>" not in r.formatted[:-8]
    got = {r.conv_id: r for r in chat.conversation_digests(formatted).collect()}
    want = {}
    for c, t, r, x in sorted(TURNS, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.conversation_digests(chat.format_turns(chat.canonical_turns(rows.where("false")))).count() == 0


def test_conversations_without_messages_and_other_ids(spark):
    kind = "id string, messages array<struct<role:string,content:string>>, turn int"
    rows = spark.createDataFrame([("a", [("user", "x"), None], 7), ("b", [], 7), ("c", None, None), (None, [("assistant", "y")], 7)], kind)
    formatted = chat.format_turns(chat.canonical_turns(rows))
    got = {r.conv_id: (r.n_turns, r.loss_chars, r.formatted_chars > 0) for r in chat.conversation_digests(formatted).collect()}
    assert got == {"a": (2, 0, True), "b": (0, 0, False), "c": (0, 0, False), None: (1, 1, True)}
    assert formatted.schema["conv_id"].dataType.simpleString() == "string"


def test_ids_from_the_table_stay(spark):
    """Ids of layouts without one are written before they are used, so every pass sees the same."""
    rows = spark.range(200).select(F.col("id").cast("string").alias("prompt"), F.col("id").cast("string").alias("completion")).repartition(5)
    turns = chat.canonical_turns(rows)
    first = {(r.conv_id, r.text) for r in turns.collect()}
    assert first == {(r.conv_id, r.text) for r in turns.repartition(3).collect()}
    assert len({i for i, _ in first}) == 200
    digests = chat.conversation_digests(chat.format_turns(turns)).collect()
    assert {r.n_turns for r in digests} == {2} and len(digests) == 200


def test_layouts(spark):
    message = "array<struct<role:string,content:string>>"
    cases = [
        ("prompt string, completion string, extra int", [("p", "c", 1)], [("user", "p"), ("assistant", "c")]),
        ("instruction string, input string, output string", [("do", "this", "done")], [("user", "do\n\nthis"), ("assistant", "done")]),
        ("instruction string, input string, output string", [("do", None, "done")], [("user", "do"), ("assistant", "done")]),
        (f"id long, messages {message}", [(3, [("system", "s"), ("user", None)])], [("system", "s"), ("user", "")]),
        ("conversations array<struct<`from`:string,value:string>>", [([("human", "h"), ("gpt", "g")],)], [("user", "h"), ("assistant", "g")]),
    ]
    for schema, rows, want in cases:
        got = chat.canonical_turns(spark.createDataFrame(rows, schema)).orderBy("turn").collect()
        assert [(r.role, r.text) for r in got] == want
    assert chat.fingerprint(T._parse_datatype_string("b string, a struct<x:int,y:array<int>>")) == chat.path_hash(["a.x", "a.y[]", "b"])
    with pytest.raises(ValueError, match="layout"):
        chat.layout_of(T._parse_datatype_string("nothing string"))
    with pytest.raises(ValueError, match="turn"):
        chat.parse_turns("<turn user>x</turn>\nrest")
