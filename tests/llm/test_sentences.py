from pyspark.sql import Row

import __spark_entry__ as entry
from whitebrook.llm import sentences


def test_p8_found_gives_units_of_every_document(spark, tmp_path):
    texts = [None, "", " \n ", "Ala ma kota. Kot ma Alę!\n\nNagłówek\n\nKoniec."]
    spark.createDataFrame([Row(doc_id=i, text=t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = entry.queries()["p8_found"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "sent_start"]
    rows = {tuple(r) for r in found.collect()}
    # every paragraph begins a unit; rows without text have none
    assert {(3, 0), (3, 26), (3, 36)} <= rows
    assert {k for k, _ in rows} == {3}


def test_words_are_counted_over_all_documents(spark, monkeypatch):
    texts = [f"Dom {i} stoi. Tutaj jest dr. Nowak i pan Nowak. Tutaj jest inny ul. Długa 5." + " I tak. Tutaj też." * 3 + "\n\nTutaj koniec." for i in range(40)] + [None, "", " \n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    whole = [t for t in texts if t and t.strip()]
    starters = sentences.starters_of(whole)
    kinds = sentences.Kinds(whole, starters)
    # with a sample of one document and a few characters, the words are still those of all
    monkeypatch.setattr(sentences.sample, "__defaults__", (1, 30))
    model = sentences.fitted(df)
    assert model.starters == starters and starters["Tutaj"] == 1
    assert model.ties == kinds.ties() and model.marked == kinds.marked() and model.marked
    got, known = sentences.statistics(df, whole)
    assert got == starters
    for name in ("free", "name", "other", "digit", "low", "behind", "begins", "quote"):
        assert getattr(known, name) == getattr(kinds, name)


def test_brackets_of_any_length():
    inner = "To jest długie zdanie w nawiasie. " * 30
    for text in (f"Dom stoi (tak mówią: {inner}Koniec.) daleko. Dalej.", f"他说（{'这是一个很长的句子。' * 60}）然后走了。结束。"):
        begin, end = brackets = sentences.brackets(text)[0]
        assert end - begin > 402 and sentences.brackets(text) == [brackets]
        ends = [e[1].end if e[0] == "may" else e[1] for e in sentences.places(text) if e[0] in ("may", "para")]
        assert ends and not [e for e in ends if begin < e < end]
    assert sentences.brackets("(a (b) c) :( (d） e) f) (g\nh)") == [(0, 9), (11, 22), (23, 28)]
    assert sentences.brackets("(a\n \nb) (c)") == [(8, 11)]
    assert sentences.brackets("(" * 50_000 + "）" * 50_000) == []


def test_reporting_words_are_learned():
    texts = ["“山很高。”某说，水很深。河很长。某人来。山很高？“好！”某说，走。" * 5, "「山。」と川。川は長い。「川？」と山。" * 5]
    starters = sentences.starters_of(texts)
    kinds = sentences.Kinds(texts, starters)
    reports = sentences.reports_of(kinds.behind, kinds.begins)
    assert {"某说", "と", "と川"} <= reports and not {"某", "某人", "河很"} & reports
    model = sentences.train(texts, starters, kinds)
    for text in ("“山很高。”某说，水很深。河很长。", "「川？」と山。川は長い。"):
        assert [text[a:b] for a, b in sentences.units(text, model)] == [text[: text.rindex("。", 0, -1) + 1], text[text.rindex("。", 0, -1) + 1 :]]


def test_stops_of_other_scripts_end_units():
    texts = ["ቤት ትልቅ ነው። ውሻ ይሮጣል። ", "မြို့ကြီးသည်။ လူများသည်။ ", "ផ្ទះធំ។ ឆ្កែរត់។ "]
    model = sentences.train([t * 20 for t in texts])
    for text in texts:
        assert len(sentences.units(text, model)) == 2, text
    lao = "ເຮືອນໃຫຍ່ ໝາແລ່ນ"
    assert [e[0] for e in sentences.places(lao)] == ["may"]


def test_the_sample_is_the_lowest_hashes_however_many_rows(spark):
    df = spark.createDataFrame([(i, f"tekst {i}" if i % 3 else " ") for i in range(900)], "doc_id long, text string").repartition(7)
    every = sentences.sample(df, "doc_id", "text", 10_000, 7)
    assert len(every) == 600 and all(len(t) <= 7 for t in every)
    for limit in (1, 10, 100):
        assert sentences.sample(df, "doc_id", "text", limit, 7) == every[:limit]
    assert sentences.sample(df.limit(0), "doc_id", "text") == []
