"""Cases in which an operator once did less than its whole job."""

import base64
import hashlib
import random

from versalia.llm import secrets, toxicity, warc


def labelled_texts(n=400, seed=8):
    """Texts of plain words, every fifth with three toxic ones."""
    rng = random.Random(seed)
    words = ["word%d" % k for k in range(200)]
    given, labels = [], []
    for k in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        for _ in range(0 if k % 5 else 3):
            t[rng.randrange(len(t))] = rng.choice(["dreadfool", "nastything"])
        given.append(" ".join(t))
        labels.append((k, int(k % 5 == 0)))
    return given, labels


def scores(spark, given, labels):
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(2)
    rows = toxicity.score_documents(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    return {r["doc_id"]: r["score"] for r in rows}


def test_words_cover_long_runs():
    run = "".join(chr(0x4E00 + k) for k in range(1001))
    got = toxicity.words_of("A short line " + run)
    assert got[:3] == ["a", "short", "line"] and max(map(len, got)) <= toxicity.LONG
    seen = "".join(got[3:])
    assert all(run[k : k + toxicity.SLICE_STEP] in seen for k in range(0, 1000, toxicity.SLICE_STEP)) and seen.endswith(run[-5:])
    assert toxicity.words_of("x" * 70 + "..ab_cd|" + "y" * 64)[-3:] == ["ab", "cd", "y" * 64]
    assert toxicity.words_of("-" * 100)[0] == "-" * toxicity.SLICE and toxicity.words_of(None) == []


def test_toxicity_reads_runs_beyond_64_characters(spark):
    given, labels = labelled_texts()
    plain = ["word%d" % (k % 200) for k in range(300)]
    toxic = plain[:150] + ["dreadfool", "nastything", "dreadfool"] + plain[150:]
    cases = [(sep.join(plain), sep.join(toxic)) for sep in (".", "_", "|", "")]
    got = scores(spark, given + [x for pair in cases for x in pair], labels)
    for k, (_, _) in enumerate(cases):
        assert got[len(given) + 2 * k] < 0.5 < got[len(given) + 2 * k + 1], k


def test_toxicity_learns_from_every_window_of_long_texts(spark):
    rng = random.Random(4)
    given, labels = [], []
    for k in range(240):
        t = ["word%d" % rng.randrange(200) for _ in range(2000)]
        if k % 3 == 0:  # in the second of 125 windows only
            t[18], t[21], t[25] = "dreadfool", "nastything", "dreadfool"
        given.append(" ".join(t))
        labels.append((k, int(k % 3 == 0)))
    got = scores(spark, given, labels)
    assert sum((got[k] >= 0.5) == (y == 1) for k, y in labels) > 230


def foreign(kind, content_type, block, **heads):
    """A record as other writers make it."""
    lines = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:0>", "Content-Type": content_type, "Content-Length": len(block)} | {f"WARC-{k}-Digest": v for k, v in heads.items()}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n" + block + warc.END


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def read_back(spark, folder, data):
    folder.mkdir()
    (folder / "a.warc.gz").write_bytes(data)
    return sorted(warc.read_warc(spark, str(folder)).collect(), key=lambda r: r["start"])


def test_warc_of_other_writers(spark, tmp_path):
    http, page, text = "application/http; msgtype=response", b"<p>a</p>\r\n\r\nb", b"one\r\n\r\ntwo"
    whole = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + page
    upper, b32 = hashlib.sha256(whole).hexdigest().upper(), base64.b32encode(hashlib.sha256(page).digest()).decode()
    records = [
        foreign("response", http, whole, Block=sha1(whole), Payload=sha1(page)), foreign("response", http, whole, Block=f"sha256:{upper}", Payload=f"sha256:{b32}"),
        foreign("resource", "text/plain", text, Payload=sha1(text)), foreign("conversion", "text/plain", b"no blank line", Block="blake3:00"), foreign("warcinfo", "application/warc-fields", text),
        foreign("response", http, whole, Payload=sha1(b"other")), foreign("resource", "text/plain", text, Block=sha1(b"other")),
    ]
    got = read_back(spark, tmp_path / "w", b"".join(map(warc.member, records)))
    assert [(r["gap"], r["payload"] and bytes(r["payload"])) for r in got] == [(None, page), (None, page), (None, text), (None, b"no blank line"), (None, text), ("payload", None), ("digest", None)]
    assert got[0]["payload_digest"] == hashlib.sha256(page).hexdigest()


def test_salvage_inside_a_member_of_many_records():
    rng = random.Random(6)
    one = [warc.record(k, "u", x := rng.randbytes(3000), hashlib.sha256(x).hexdigest(), None) for k in range(6)]
    pages = lambda found: [warc.page_of(x[3]["warc-record-id"]) for x in found if x[0] == "record"]
    last = warc.member(one[5])
    bad = bytearray(one[2])
    bad[-100] ^= 255
    packed = warc.member(b"".join([*one[:2], bad, *one[3:5]]))
    found = list(warc.salvage(packed + last))
    assert pages(found) == [0, 1, 3, 4, 5] and [x[1:4] for x in found if x[0] == "gap"] == [(0, len(packed), "digest")]
    packed = warc.member(b"".join(one[:5]))
    found = list(warc.salvage(packed[:-4000]))
    assert pages(found) == [0, 1, 2] and [x[1:4] for x in found if x[0] == "gap"] == [(0, len(packed) - 4000, "member")]
    wrong = packed[:-8] + bytes(4) + packed[-4:]  # the checksum fails, each record's digest holds
    found = list(warc.salvage(wrong + last))
    assert pages(found) == [0, 1, 2, 3, 4, 5] and [x[1:4] for x in found if x[0] == "gap"] == [(0, len(packed), "member")]


def test_keys_of_one_case_are_candidates(spark):
    upper, lower, copied = "K7Q2ZJ4XW5M3RT6BN2PVA7", "sk_live_908172635444536", "EX4MPL3K3YTHATALLC0PY99"
    plain = ["a-report-of-2024-01-02-by-many-people", "UPPER_CASE_NAME_OF_2024_0102", "12345678901234567890123", "550e8400-e29b-41d4-a716-446655440000", "internationalization-2024-01-02"]
    given = [f"x {upper} y", f"x {lower} y", *[f"see {copied} here"] * 3, *plain]
    docs = spark.createDataFrame([(k, x, f"o{k}/r", len(x)) for k, x in enumerate(given)], "doc_id long, text string, source string, n_chars long")
    rows = {r["doc_id"]: r for r in secrets.find_secrets(docs).collect()}
    assert [rows[k]["spans"] for k in range(len(given))] == ["token:2:24", "token:2:25", *[""] * 8]
    owned = sorted(r["owners"] for r in secrets.ownership(secrets.scan(docs)).collect())
    assert owned == [1, 1, 3]  # the copied key is a candidate too
    masked = {r["doc_id"]: r["text"] for r in secrets.mask_secrets(docs).collect()}
    assert [masked[k] for k in range(len(given))] == ["x [SECRET] y"] * 2 + given[2:]
