import re
from collections import Counter

from mediagrain.llm import repetition

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                dup += 1
                dup_chars += sum(map(len, WORD.findall(line)))
            seen.add(line)
    n = len(words)
    chars = sum(map(len, words))
    kept = dup_chars <= repetition.MAX_LINE_SHARE * max(chars, 1)
    for k, most in repetition.MAX_GRAM_SHARE.items():
        before, inside = set(), set()
        for i in range(n - k + 1):
            g = tuple(words[i : i + k])
            if g in before:
                inside.update(range(i, i + k))
            before.add(g)
        kept = kept and sum(len(words[j]) for j in inside) <= most * max(chars, 1)
    failed = n < 50 or 100 * len(hit) > 50 * n
    return n, chars, len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed, kept and not failed


def test_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in repetition.op7(spark, sf).collect():
        assert tuple(r)[1:] == brute(texts[r.doc_id]), r.doc_id


def test_odd_texts(spark, odd_docs, no_docs):
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    got = repetition.judge(repetition.repetition_coverage(odd_docs)).collect()
    assert len(got) == 9
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == brute(texts[r.doc_id])
    assert repetition.repetition_coverage(no_docs).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c " * 30, 5, 6)], "doc_id int, text string, n_words int, word_chars int")
    assert repetition.repetition_coverage(df).first().n_words == 90
