from texts import prose

from tradewind.llm import span_dedup


def deduped(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in span_dedup.span_dedup(docs).collect()}


def test_short_sentences_are_in_spans(spark):
    """Thirty lines of three words each: no three of them have twelve words."""
    words = prose(11, 90).replace(".", "").split()
    lines = "".join(f"{' '.join(words[k : k + 3])}\n" for k in range(0, 90, 3))
    got = deduped(spark, [f"{prose(1, 45)}\n{lines}{prose(2, 45)}", f"{prose(3, 27)}\n{lines}{prose(4, 27)}"])
    assert got[0]["n_removed"] == 0 and got[1]["n_removed"] == 30
    assert got[1]["kept_text"] == f"{prose(3, 27)}\n{prose(4, 27)}"


def test_every_sentence_of_a_passage_goes(spark):
    """Long sentences first and short ones last, or the reverse; short texts as a whole."""
    tail = f"{prose(12, 9)} Yes. No. So. Be it."
    head = f"Yes. No. So. Be it. {prose(13, 9)}"
    for passage in (tail, head):
        got = deduped(spark, [f"{prose(1, 45)} {passage} {prose(2, 45)}", f"{prose(3, 27)} {passage} {prose(4, 27)}"])
        assert got[1]["kept_text"] == f"{prose(3, 27)} {prose(4, 27)}"
    got = deduped(spark, ["One two.", "One two.", "One three.", None, ""])
    assert [got[k]["kept_text"] for k in range(5)] == ["One two.", "", "One three.", "", ""]


def test_long_sentences_are_cut_alike_wherever_they_stand(spark):
    """One passage of eighty words without a stop, behind prefixes of any length."""
    plain = prose(21, 80).replace(".", "").lower()
    fill = lambda seed, n: prose(seed, n).replace(".", "").lower()
    got = deduped(spark, [f"{fill(30 + n, 40 + n)} {plain} {fill(60 + n, 40)}" for n in range(9)])
    assert got[0]["n_removed"] == 0
    for n in range(1, 9):
        assert len(got[n]["kept_text"].split()) <= 80 + n + 24, n  # of 80 words at least 56 go


def test_sentence_ends(spark):
    """Ends before closing marks, of other scripts, and the cells of tables."""
    passages = [
        '"Ari went to the old mill." (Bel sat on a red wall!) ‘Cal ran to the far gate.’ «Dee fed all the grey hens?»',
        "मोहन बाज़ार जाता है। सीता घर पर रहती है। राम खेत में काम करता है।",
        "春天來了花開滿園。「他們去山上看日出！」孩子在河邊放風箏？我們明天再見面吧。",
        "| red cup | 44 pcs | dry store | blue jug | 12 pcs | wet store |",
        "春天來了花開滿園\n他們去山上看日出\n孩子在河邊放風箏\n我們明天再見面吧",
    ]
    for passage in passages:
        got = deduped(spark, [f"Here it begins at first. {passage}\nAnd this goes on.", f"Zed opens. {passage}\nBut that is other."])
        assert got[1]["kept_text"] == "Zed opens. But that is other.", passage
