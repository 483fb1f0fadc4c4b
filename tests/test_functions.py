import random

import pytest
from pyspark.sql import functions as F

from wordsonar.functions import distance, keyboard, phonetic, text
from wordsonar.model import Options, SearchType


def slow(query: str, target: str) -> int:
    """The distance by its recurrence, one cell at a time."""
    m, n = len(query), len(target)
    if not m or not n:
        return 2 * (m + n)
    d = [[2 * j for j in range(n + 1)]] + [[2 * i] + [0] * n for i in range(1, m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            step = 1 if i == m else 2
            a, b = query[i - 1], target[j - 1]
            d[i][j] = min(d[i - 1][j] + step, d[i][j - 1] + step, d[i - 1][j - 1] + keyboard.cost(a, b))
            if i > 1 and j > 1:
                keys = [keyboard.KEY_OF.get(c) for c in (query[i - 2], a, target[j - 2], b)]
                if None not in keys and keys[0] == keys[3] and keys[1] == keys[2]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 2)
    return d[m][n]


GOLDEN = [
    ("KITTEN", "SITTING", 5), ("SATURDAY", "SUNDAY", 6), ("EXAMPLE", "SAMPLES", 4), ("HELLO", "HALLO", 2), ("ABC", "ABD", 1), ("ABCDEFG", "ABCDFG", 2), ("и", "о", 2),
    ("HELLO", "HEO", 4), ("ABCDEFG", "ABDEFGH", 3), ("EXAMPLE", "EXMPLE", 2), ("ПРОВЕРКА", "ПРОВЕРЬКА", 2), ("СОЛНЦЕ", "СОЛНЫШКО", 5), ("☺", "☻", 2), ("", "ABC", 6),
    ("GHBDTN", "ПРИВЕТ", 0), ("ДОГОВРА", "ДОГОВОР", 3), ("HOUSE", "HOUES", 2), ("ABCD", "BCDE", 3),
]


@pytest.mark.parametrize("query,target,d", GOLDEN)
def test_distance(query, target, d):
    assert distance.distance(query, target) == d == slow(query, target)
    for most in range(8):
        assert distance.distance(query, target, most) == min(d, most + 1)


def test_distance_random():
    r = random.Random(5)
    for _ in range(1500):
        a, b = ("".join(r.choice("ABSDФЫ1!") for _ in range(r.randint(1, 7))) for _ in range(2))
        assert distance.distance(a, b) == slow(a, b)


def test_negative_bound():
    with pytest.raises(ValueError):
        distance.distance("A", "B", -1)


def test_keyboard_tables():
    assert len(keyboard.KEY_OF) == 102 and len(keyboard.BESIDE) == 46 and sum(map(len, keyboard.BESIDE.values())) == 213
    one_way = {(a, b) for a, around in keyboard.BESIDE.items() for b in around if a not in keyboard.BESIDE.get(b, ())}
    assert one_way == {(192, 49), (186, 188), (190, 186)}
    assert keyboard.KEY_OF[";"] == 52 and keyboard.KEY_OF[","] == keyboard.KEY_OF["."] == 191 and keyboard.KEY_OF[":"] == 54 and keyboard.KEY_OF['"'] == 50 and keyboard.KEY_OF["?"] == 55
    assert keyboard.cost("a", "s") == 2 and keyboard.cost("A", "S") == 1 and keyboard.cost("Q", "Й") == 0


@pytest.mark.parametrize("a,b,d", [("ABCDEFG", "ABCXDEFG", 1), ("AB", "CAB", 1), ("AB", "ABC", 1), ("AB", "AB", 0), ("AB", "AS", 2), ("ABC", "ABD", 1), ("AB", "ABCD", 2), ("QW", "ЙЦ", 0)])
def test_up_to_one(a, b, d):
    assert distance.up_to_one(a, b) == d


def test_windows():
    assert distance.window_distances("PROCESS", ["ULTRAPROCESSORMODULE", "PROCESS", "PRPCESS"], True).tolist() == [0, 0, 2 if keyboard.cost("O", "P") == 2 else 1]
    assert distance.window_distances("AB", ["ABX", "XAB"], False).tolist()[0] == 0


def test_distance_column(spark):
    df = spark.createDataFrame([("HELLO",), (None,), ("HALLO",), ("",)], "w string")
    assert [r.d for r in df.select(distance.keyboard_distance("HELLO", F.col("w"), 3).alias("d")).collect()] == [0, None, 2, 4]


def test_allowed():
    allowed = lambda length, precision, misprints=-1: Options(SearchType.NEAR, 0, precision, misprints).allowed(length)
    assert [allowed(10, -1), allowed(10, 100), allowed(10, 55), allowed(1, 0), allowed(7, 50)] == [10, 0, 5, 0, 4] and allowed(10, 100, 3) == 3


@pytest.mark.parametrize("word,up", [("straße", "STRAßE"), ("привет", "ПРИВЕТ"), ("éß", "Éß"), ("ﬁx", "ﬁX"), ("ı", "ı")])
def test_simple_upper(spark, word, up):
    assert text.simple_upper_str(word) == up
    assert spark.createDataFrame([(word,)], "w string").select(text.simple_upper(F.col("w"))).first()[0] == up


def test_words(spark):
    rows = [("Check, the (process)!",), ("a b2 cc\ndd 19.09.2023",), (None,), ("",)]
    df = spark.createDataFrame(rows, "t string")
    assert [r[0] for r in df.select(text.words(F.col("t"))).collect()] == [["CHECK", "THE", "PROCESS"], ["CC\nDD"], None, []]
    assert df.select(text.words(F.col("t"), "e", True)).first()[0] == ["CH", "CK, TH", " (PROC", "SS)!"]
    assert text.query_terms("  the Check, the a x1 ") == ("CHECK", "THE", "X1")


KEYS = [
    ("Иванов", "ИФАНОФ", "ИФАНАФ"), ("Петров", "ПЕТРОФ", "ПИТРАФ"), ("Соловьёв", "СОЛОФЕФ", "САЛАФИФ"), ("Салтыков-Щедрин", "САЛТИКОФШЕТРИН", "САЛТИКАФШИТРИН"),
    ("Дьяченко", "ТАШЕНКО", "ТАШИНКА"), ("Анна", "АНА", "АНА"), ("Алла", "АЛА", "АЛА"), ("Семёнов", "СЕМЕНОФ", "СИМИНАФ"), ("Папондопуло", "ПАПОНТОПУЛО", "ПАПАНТАПУЛА"),
    ("Забабонова", "САПАПОНОФА", "САПАПАНАФА"), ("Ivanov", "ИФАНОФ", "ИФАНАФ"), ("Smith", "", ""), ("12345", "", ""), (" ", "", ""), (None, "", ""), ("Иванов Smith", "", ""),
]


def test_sound_keys(spark):
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(KEYS)], "k int, name string, strict string, approx string")
    name = F.col("name")
    rows = df.select("*", phonetic.first_key(name, False).alias("s"), phonetic.first_key(name).alias("a")).collect()
    assert [(r.name, r.s, r.a) for r in rows] == KEYS
    for n, s, a in KEYS:
        assert (phonetic.keys_str(n, False) or [""])[0] == s and (phonetic.keys_str(n) or [""])[0] == a


@pytest.mark.parametrize("name,kind", [("Иванов", "RussianCyrillic"), ("Сидоров-Петров", "RussianCyrillic"), ("Ivanov", "RussianLatin"), ("Shcherbakov", "RussianLatin"), ("Smith", "Unknown"), ("Иванов Smith", "Unknown"), ("12345", "Unknown"), ("  ", "Unknown")])
def test_language(spark, name, kind):
    assert phonetic.language_str(name) == kind
    assert spark.createDataFrame([(name,)], "n string").select(phonetic.language(F.col("n"))).first()[0] == kind


@pytest.mark.parametrize("name,cyrillic", [("Shcherbakov", "ЩЕРБАКОВ"), ("Tchaikovsky", "ЧАИКОВСКИ"), ("Dzhafarov", "ДЖАФАРОВ"), ("D'Yachenko", "ДЯЧЕНКО"), ("Kharlamov", "ХАРЛАМОВ"), ("Maximov", ""), ("Tsch", "ЦЧ"), ("T sh", "ТШ")])
def test_transliteration(name, cyrillic):
    assert phonetic.cyrillic_of(name) == cyrillic


def test_metaphone():
    assert phonetic.metaphone("Петров") == "ПИТРАФ" and phonetic.metaphone("Зуб") == "ЗУП" and phonetic.metaphone("воз") == "ВАC" and phonetic.metaphone("Детство") == "ДИЦСТВА"
    assert phonetic.metaphone("Knight") == phonetic.metaphone("Night") and phonetic.metaphone("Phone").startswith("FO") and phonetic.metaphone("Xena")[0] == "S"
    assert phonetic.metaphone("Смит Smith") == "" and phonetic.metaphone("K") == "K" and phonetic.metaphone("") == ""
    assert [phonetic.char_set(x) for x in ("аб", "ab", "аb", "12", "a1")] == ["Cyrillic", "Latina", "Combine", "Other", "Latina"]


def test_metaphone_by_columns(spark):
    """Keys by hand from the rules: Russian by built-in functions, English by the rules, equal to the Python version."""
    by_hand = {
        "ПЕТРОВ": "ПИТРАФ", "ЗУБ": "ЗУП", "ВОЗ": "ВАC", "ДЕТСТВО": "ДИЦСТВА", "ЙОД": "ИТ", "АННА": "АНА", "СЪЕЗД": "СИCТ", "МАРИЯ": "МАРИА", "ВТОРНИК": "ФТАРНИК",
        "KNIGHT": "NIHT", "PHONE": "FONE", "XENA": "SENA", "TOMB": "TOM", "WHO": "WO", "EDGE": "EJJE", "THIN": "OIN", "MATCH": "MACH", "CIA": "XIA", "BOX": "BOKS", "SCHOOL": "SKHOL", "CITY": "SITY", "LETTER": "LETER",
        "СМИТ SMITH": "", "12": "", "K": "K",
    }
    rows = spark.createDataFrame([(w,) for w in by_hand] + [(None,)], "w string").select("w", phonetic.metaphone_key("w").alias("key")).collect()
    assert {r.w: r.key for r in rows if r.w} == by_hand == {w: phonetic.metaphone(w) for w in by_hand}
    assert [r.key for r in rows if r.w is None] == [None]


def test_upper_is_one_for_one(spark):
    some = ["straße ŉ ı \ue100\ue101", "ÿǆ ﬁ 𐐨", "éàñ ПРИвет"]
    found = [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(some)], "k int, x string").orderBy("k").select(text.simple_upper(F.col("x"))).collect()]
    assert found == [text.simple_upper_str(x) for x in some] == ["STRAßE ŉ ı \ue100\ue101", "ŸǄ ﬁ 𐐀", "ÉÀÑ ПРИВЕТ"]
