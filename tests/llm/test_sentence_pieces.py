import struct
import weakref

import pytest
import sentencepiece

from lendwell.llm import sentence_pieces as s
from lendwell.llm.common import table

ODD = [
    "", " ", "  a  b ", "\n\n x", "日本語 test 🎉", "\x00a", "aaa aaaa aaaaaaaaaaaa", "\u00a0x", " lead", "trail  ", "end ",
    "w" * 3000, "plain words, with a stop.", "tab\tand\r\nlines", "ÀÉ ñandú Straße", "x" + " " * 50 + "y",
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, [1], True) for r in rows], "doc_id long, text string, ids array<int>, parity boolean")


def test_parity_and_round_trip(spark):
    rows = list(enumerate(ODD)) + [(None, "no id"), (100, None), (7, ODD[7])]
    encoded = s.encoded(frame(spark, rows))
    got = sorted(encoded.collect(), key=lambda r: (str(r["doc_id"]), r["n_tokens"]))
    processor = sentencepiece.SentencePieceProcessor(model_file=s.MODEL_FILE)
    want = sorted(((d, processor.encode(t or "")) for d, t in rows), key=lambda r: (str(r[0]), len(r[1])))
    assert [(r["doc_id"], r["ids"]) for r in got] == want
    assert all(r["parity"] and r["restored"] and r["n_tokens"] == len(r["ids"]) for r in got)
    back = s.decoded(encoded).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(d), t or "") for d, t in rows)


def test_whole_texts_of_a_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = {r["doc_id"]: r["ids"] for r in s.encoded(docs).collect()}
    processor = sentencepiece.SentencePieceProcessor(model_file=s.MODEL_FILE)
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        assert got[doc] == processor.encode(text) and processor.decode(got[doc]) == text, doc


def test_marker_in_text_is_not_restored(spark):
    got = s.encoded(frame(spark, [(1, "a▁b")])).first()
    assert got["parity"] and not got["restored"]


def test_small_caches_change_nothing(monkeypatch):
    data = s.model_bytes(s.MODEL_FILE)
    monkeypatch.setattr(s, "KNOWN_PARTS", 3)
    few = s.Encoder(data)
    texts = ["a b c d e f", "g h i a b", "", "c d"]
    pieces = [few([t]) for t in texts]
    flat, ends, _, _ = s.Encoder(data)(texts)
    assert [p[0].tolist() for p in pieces] == [flat[a:b].tolist() for a, b in zip(ends, ends[1:])]


def test_short_of_memory_changes_no_rows(spark):
    assert s.Encoder(s.model_bytes(s.MODEL_FILE), True).most_known < s.KNOWN_PARTS
    docs = frame(spark, list(enumerate(ODD)))
    assert s.encoded(docs, short_of_memory=True).collect() == s.encoded(docs).collect()


def test_full_caches_keep_the_parts_of_the_batch(monkeypatch):
    monkeypatch.setattr(s, "KNOWN_PARTS", 3)
    encoder = s.Encoder(s.model_bytes(s.MODEL_FILE))
    own, asked = encoder.processor, []

    class Noting:
        def encode(self, some, num_threads):
            asked.append(sorted(some))
            return own.encode(some, num_threads=num_threads)

    encoder.processor = Noting()
    for text in ("a b c d▁e", "a b c d", "a b x", "c"):
        encoder([text])
    # The first text goes whole; then "a" and "b" stay, "c" and "d" make room.
    assert asked == [["a b c d▁e"], ["a", "b", "c", "d"], ["x"], ["c"]]
    assert encoder.unlike == set()


def test_model_file(tmp_path):
    model = s.parsed(s.model_bytes(s.MODEL_FILE))
    assert model.kind == s.BPE and model.byte_fallback and len(model.pieces) == 32000 and model.unknown == 0
    with pytest.raises(ValueError):
        s.parsed(b"\x0a\x09\x0a\x05a\xe2\x96\x81b\x18\x01")


def test_empty_table(spark):
    assert s.encoded(frame(spark, [])).count() == 0


def message(fields):
    """Fields of one message in the wire format: numbers, floats, text or bytes."""

    def varint(n):
        out = bytearray()
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        return bytes(out + bytes([n]))

    out = b""
    for number, value in fields:
        if isinstance(value, bool) or isinstance(value, int):
            out += varint(number << 3) + varint(int(value))
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            data = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(data)) + data
    return out


def unigram_model(fallback, trim, mapped):
    """A small unigram model, with or without byte fallback, trimmed spaces and a map of characters."""
    pieces = [("<unk>", 0.0, s.UNKNOWN), ("<s>", 0.0, s.CONTROL), ("</s>", 0.0, s.CONTROL)]
    if fallback:
        pieces += [(f"<0x{b:02X}>", 0.0, s.BYTE) for b in range(256)]
    words = ["▁", "▁the", "▁th", "e", "h", "t", "he", "▁cat", "▁c", "at", "a", "c", "s", "▁s", "sat", "on", "▁on", "o", "n", ".", "fi", "1", "2", "Å", "ñ"]
    pieces += [(w, -1.0 - 0.37 * i, s.NORMAL) for i, w in enumerate(words)]
    rules = [(1, "test"), (2, b"")]
    if mapped:
        whole = dict(s.fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()))[s.NORMALIZER]
        rules = [(1, "nmt_nfkc"), (2, dict(s.fields(whole))[2])]
    rules += [(3, True), (4, trim), (5, True)]
    trainer = [(3, s.UNIGRAM), (35, fallback)]
    return message(
        [(s.PIECES, message([(1, p), (2, score), (3, kind)])) for p, score, kind in pieces]
        + [(s.TRAINER, message(trainer)), (s.NORMALIZER, message(rules))]
    )


@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("trim", [True, False])
@pytest.mark.parametrize("mapped", [True, False])
def test_unigram_models(spark, tmp_path, fallback, trim, mapped):
    data = unigram_model(fallback, trim, mapped)
    model = s.parsed(data)
    assert model.kind == s.UNIGRAM and model.byte_fallback == fallback and bool(model.character_map) == mapped
    path = tmp_path / "unigram.model"
    path.write_bytes(data)
    processor = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["the cat sat on the cat.", "  the   cat ", "ﬁ ﬁt Å ñ １２", "the\tcat\nsat", "zebra 日本 🎉", "", " ", "cat" * 50, "the  ", "é ñ"]
    got = {r["doc_id"]: r for r in s.encoded(frame(spark, list(enumerate(texts))), str(path)).collect()}
    for i, text in enumerate(texts):
        assert got[i]["ids"] == processor.encode(text), (text, fallback, trim, mapped)
        assert got[i]["parity"]


def test_parts_of_one_text_at_a_time(monkeypatch):
    encoder = s.Encoder(s.model_bytes(s.MODEL_FILE))
    cut, alive = encoder.parts, []

    class Parts(list):
        """A list that can be watched."""

    def watched(text):
        parts = Parts(cut(text))
        alive.append(weakref.ref(parts))
        return parts

    monkeypatch.setattr(encoder, "parts", watched)
    most = []
    monkeypatch.setattr(encoder, "learn", lambda parts: (most.append(sum(a() is not None for a in alive)), s.Encoder.learn(encoder, parts)))
    texts = [f"some words of text {n}" for n in range(50)]
    flat, ends, _, _ = encoder(texts)
    assert max(most) <= 1
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == encoder.processor.encode(texts)
