"""Adversarial texts of a megabyte on every operator: nothing crashes, and results are whole."""

import public_tokenizers
import pytest

from sluice.llm import exact_dedup, gif_media, language_id, mixing, near_dedup, pii, quality, quotations, sentencepiece_fst, token_counts

MB = 1 << 20
TEXTS = {
    "dots after @": "x@" + "a." * (MB // 2),
    "quote marks": "> " * (MB // 2),
    "blank lines": "> said\n" + "\n" * MB + "end",
    "blank lines at the end": "> said\nend" + " \n" * (MB // 2),
    "digits": "4111 1111 1111 1111 " * (MB // 20),
    "one number": "7" * MB,
    "brackets": "(((" * (MB // 3),
    "letters": "ab" * (MB // 2),
    "spaces": " " * MB,
    "secret": "password=" + "aB3" * (MB // 3),
    "local part": "ab1." * (MB // 4) + "@example.com",
    "dates": "12/31/2020 2020-12-31 " * (MB // 22),
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(TEXTS.values())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(len(rows)).persist()


def test_pseudonyms(docs):
    got = {r.doc_id: r for r in pii.pii_report(docs, "k").collect()}
    names = list(TEXTS)
    for i, name in enumerate(names):
        assert len(got[i].text) == len(TEXTS[name]), name
    assert got[names.index("digits")].n_replaced == MB // 20 and "4111 1111 1111 1111" not in got[names.index("digits")].text
    assert got[names.index("secret")].n_replaced == 1 and got[names.index("dates")].n_replaced == 2 * (MB // 22)
    for name in ("dots after @", "quote marks", "one number", "brackets", "letters", "spaces"):
        assert (got[names.index(name)].text, got[names.index(name)].n_replaced) == (TEXTS[name], 0), name


def test_quotations(spark):
    rows = [(1, i, "user", t) for i, t in enumerate(TEXTS.values())] + [(1, 100, "user", "\n".join("> " * (1 + i % 40) + f"line number {i} here" for i in range(20_000)))]
    got = {r.turn: r for r in quotations.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == len(rows) and sorted(r.position for r in got.values()) == list(range(len(rows)))
    names = list(TEXTS)
    assert got[names.index("blank lines")].text == "end" and got[names.index("quote marks")].text == "" and got[names.index("blank lines at the end")].text.strip() == "end"
    assert got[100].n_quotes == 20_000 and got[100].text == ""


def test_tokens(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path).collect()}
    for i, t in enumerate(TEXTS.values()):
        assert got[i] == len(library.encode(t, add_special_tokens=False).ids)


def test_sentencepiece(docs):
    got = sentencepiece_fst.encoding_digests(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(got) == len(TEXTS) and all(r.exact for r in got)


def test_the_others(docs):
    n = len(TEXTS)
    assert exact_dedup.exact_dedup(docs).where("kept").count() == n
    assert near_dedup.near_dedup(docs).where("kept").count() == n - 1  # two have the same words
    assert {r.lang_pred for r in language_id.language_report(docs).collect()} <= {"en", "und"}
    assert gif_media.media_digests(docs).count() == n
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    assert quality.quality_scores(docs, labels).count() == n
    assert mixing.mix(docs).count() == n and mixing.mixed_documents(docs).where("text is null").count() == 0
