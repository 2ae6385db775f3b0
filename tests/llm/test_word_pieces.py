import random

from brute import awkward_documents, empty_like
from tokenizers import models

from tallyframe.llm import word_pieces as P
from tallyframe.llm.queries import VOCABULARY, op9_word_piece_counts


def greedy(word, start, rest):
    n, at = 0, 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in (rest if at else start)), None)
        if end is None:
            return None
        n, at = n + 1, end
    return n


def test_random_vocabularies():
    rng = random.Random(1)
    for _ in range(300):
        word = lambda m: "".join(rng.choice("abc") for _ in range(rng.randint(1, m)))
        start, rest = {word(5) for _ in range(8)}, {word(4) for _ in range(8)}
        a = P.Automaton(start, rest)
        for w in [word(12) for _ in range(60)] + [""]:
            assert a.count(w) == greedy(w, start, rest), (w, start, rest)


def test_against_a_tokenizer_library(spark):
    start, rest = P.read_pieces(VOCABULARY)
    vocab = {w: i for i, w in enumerate(dict.fromkeys([*start, *["##" + w for w in rest], "[UNK]"]))}
    model = models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=10 ** 6)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.id: (r.n_words, r.n_tokens) for r in P.count_pieces(docs, VOCABULARY).collect()}
    for d in docs.collect():
        words = P._WORD.findall(d.text or "")
        assert got[d.doc_id] == (len(words), sum(len(model.tokenize(w)) for w in words))


def test_long_word_is_linear():
    start, rest = {"a" * i for i in range(1, 200)}, {"a" * i for i in range(1, 200)} | {"b"}
    assert P.Automaton(start, rest).count("a" * 1_000_000 + "b") == 1_000_000 // 199 + 2


def test_awkward_rows(spark):
    docs = awkward_documents(spark)
    vocabulary = (["w", "wo", "word"], ["and", "1", "2", "d"])
    got = P.count_pieces(docs, vocabulary).collect()
    want = []
    for d in docs.collect():
        n = [greedy(w, set(vocabulary[0]), set(vocabulary[1])) for w in P._WORD.findall(d.text or "")]
        want.append((str(d.doc_id), len(n), sum(x or 1 for x in n), n.count(None)))
    assert sorted((str(r.id), r.n_words, r.n_tokens, r.n_unknown) for r in got) == sorted(want)
    assert P.count_pieces(empty_like(docs), vocabulary).count() == 0


def spelled(word, pieces):
    """Greedy longest match over all pieces of the file, bytes for the rest."""
    n, at, word = 0, 0, "▁" + word
    while at < len(word):
        end = next((e for e in range(min(len(word), at + 60), at, -1) if word[at:e] in pieces), None)
        n, at = (n + 1, end) if end else (n + len(word[at].encode()), at + 1)
    return n


def test_random_vocabularies_with_the_bare_mark():
    rng = random.Random(2)
    for _ in range(300):
        word = lambda m: "".join(rng.choice("abcé") for _ in range(rng.randint(1, m)))
        start, rest = {word(5) for _ in range(8)}, {word(4) for _ in range(8)}
        a = P.Automaton(start, rest, mark=True, by_bytes=True)
        pieces = {"▁", *("▁" + w for w in start), *rest}
        for w in [word(12) for _ in range(60)]:
            assert a.count(w) == spelled(w, pieces), (w, start, rest)


def test_every_character_is_counted(spark):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    docs = spark.createDataFrame([(1, "中文日本語" * 40), (2, "ñción"), (3, "ع" * 9), (4, "\U00012000a ß")], "doc_id int, text string")
    got = {r.id: r for r in P.count_pieces(docs, VOCABULARY, spelled=True).collect()}
    for d in docs.collect():
        assert got[d.doc_id].n_tokens == sum(spelled(w, pieces) for w in P._WORD.findall(d.text)) and got[d.doc_id].n_unknown == 0
    assert got[1].n_tokens > 100
    sf = "/root/testdata/sf0.001"
    table = {r.doc_id: r for r in op9_word_piece_counts(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect():
        assert table[d.doc_id].n_tokens == sum(spelled(w, pieces) for w in P._WORD.findall(d.text or "")) and table[d.doc_id].n_unknown == 0
