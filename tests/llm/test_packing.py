import random
import struct
import zlib
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

from clickloom.llm import packing
from clickloom.llm.packing import Limits, pack

DOCS = "doc_id long, text string, length string"


@pytest.fixture(scope="module")
def tool():
    return Tokenizer.from_file(packing.default_tokenizer())


def ids_of(tool, text):
    return [*tool.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def check(rows, docs, tool, limits):
    """Every id in exactly one piece, with the right checksum, and no gap in a sequence."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    texts = defaultdict(list)
    for doc_id, text in docs:
        texts[doc_id].append(ids_of(tool, text))
    for doc_id, found in texts.items():
        got = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces[doc_id])
        if len(found) > 1:
            assert sum(g[1] for g in got) == sum(map(len, found))
            continue
        at = 0
        for start, length, crc, total in got:
            part = found[0][start : start + length]
            assert (start, total) == (at, len(found[0])) and length > 0
            assert crc == zlib.crc32(struct.pack(f"<{length}I", *part))
            at += length
        assert at == len(found[0])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limits.tokens and len(own) <= limits.segments
        assert sum(r.loss_tokens for r in own) <= limits.loss
    return [sum(r.length for r in own) for own in sequences.values()]


TEXTS = [
    (1, "plain words, and more words."),
    (2, None),
    (3, ""),
    (4, "Don't <|endoftext|> stop \x1c here now 12!? ünïcode İstanbul"),
    (5, "long text with many words " * 3000),
    (6, "same"),
    (6, "same"),
    (None, "no id***"),
    (7, "x" * 9000),
    (8, "word+++ a1b2 --- éte   end"),
]


@pytest.mark.parametrize(
    "limits",
    [
        Limits(),
        Limits(tokens=64, segments=2, loss=40, waiting=1),
        Limits(tokens=7, segments=1, loss=7, waiting=3),
    ],
)
def test_each_id_lies_in_one_piece(spark, tool, limits):
    docs = spark.createDataFrame([(i, t, "x") for i, t in TEXTS], DOCS).coalesce(1)
    rows = pack(docs, packing.default_tokenizer(), limits).collect()
    lengths = check(rows, TEXTS, tool, limits)
    if limits.loss == limits.tokens and limits.segments > 1:
        short = [n for n in lengths if n < limits.tokens]
        assert all(n & (n - 1) == 0 for n in short)


def test_prompt_tokens_bear_no_loss(spark, tool):
    docs = spark.createDataFrame([(k, "a b c d e f g h", 6) for k in range(20)], "doc_id long, text string, p int")
    limits = Limits(tokens=32, segments=8, loss=9, waiting=4)
    rows = pack(docs.coalesce(1), packing.default_tokenizer(), limits, "p").collect()
    check(rows, [(k, "a b c d e f g h") for k in range(20)], tool, limits)
    assert sum(r.loss_tokens for r in rows) == 20 * 3


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], DOCS), packing.default_tokenizer()).count() == 0


def test_words_kept_from_before_change_nothing(tool):
    encoder = packing.WordEncoder(packing.public_tokenizer(packing.default_tokenizer()), 600)
    for text in ["one two three, four!", "two five six? seven", "one two eight%%% nine"] * 2:
        ids = ids_of(tool, text)[:-1]
        assert encoder.encode([text]) == [struct.pack(f"<{len(ids)}I", *ids)]


LETTERS = [
    "abcdefgh", "ABCXYZ", "äöüßÄÖÜẞ", "éèêëçÉÈ", "İıŞşĞğ", "ΑΒΓαβγςΣ", "АБВабвё", "אבגד", "ابتة",
    "हिन्दी", "漢字仮名", "ひらがな", "한국어", "ไทย", "0123456789", "ŉǰΐΰẖ", "ﬁﬂ", "ǄǅǆÅ", "́̇ͅ", "'-_’",
]


def test_ids_of_many_scripts(tool):
    """Words learnt together, with and without marks, give the ids of their whole texts."""
    draw = random.Random(4)

    def word():
        sets = draw.choices(LETTERS, k=1 if draw.random() < 0.6 else 2)
        out = "".join(draw.choice(draw.choice(sets)) for _ in range(draw.randint(1, 7)))
        return out + "".join(draw.choices(packing.MARKS, k=draw.choice([0, 0, 0, 1, 1, 2])))

    words = [word() for _ in range(6000)]
    texts = [" ".join(draw.choices(words, k=draw.randint(1, 4))) for _ in range(50_000)]
    texts += ["ALİ, YENİ.", "İKİ! ŞEHİR", "İ.", "a\u0307. b\x1c.", " İ, \n\t İ!?"]
    encoder = packing.WordEncoder(packing.public_tokenizer(packing.default_tokenizer()), 100_000)
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        whole = [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in tool.encode_batch(part, add_special_tokens=False)]
        different = [t for t, a, b in zip(part, encoder.encode(part), whole) if a != b]
        assert not different


def test_loss_limit_binds(spark, tool):
    """Examples of conversations: the prompt bears no loss, and loss-bearing tokens fill up first."""
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").toPandas()
    turns = turns.sort_values(["conv_id", "turn"])
    rows = []
    for conv, own in turns.groupby("conv_id"):
        prompt, answer = own.text.iloc[0], " ".join(own.text.iloc[1:])
        rows.append((int(conv), f"{prompt} {answer}", len(ids_of(tool, prompt)) - 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, prompt long").coalesce(1)
    limits = Limits(tokens=4096, segments=16, loss=900, waiting=64)
    found = pack(df, packing.default_tokenizer(), limits, "prompt").collect()
    check(found, [(r[0], r[1]) for r in rows], tool, limits)
    loss = defaultdict(int)
    for r in found:
        loss[r.sequence_id] += r.loss_tokens
    full = [n for n in loss.values() if n == limits.loss]
    assert len(full) > len(loss) // 2
    tokens = defaultdict(int)
    for r in found:
        tokens[r.sequence_id] += r.length
    assert max(tokens.values()) < limits.tokens  # the loss limit is the one that binds
