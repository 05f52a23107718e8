import random

import pytest

from silverloom.llm.mojibake import garbled, judged, repair

SAMPLES = {
    "de": "Während der Wartung dürfen keine Löschungen größer als nötig ausgeführt werden.",
    "fr": "Où se trouve la référence à l’été ? Ça marche très bien, même lorsque l’entrée est vide.",
    "es": "¿Por qué la contraseña caduca tras 30 días? También conviene revisar la sesión.",
    "pt": "A avaliação mostrou uma redução no número de colisões; não há razão.",
    "sv": "Sökningen är långsam för stora träd och åäö.",
    "pl": "Część żądań została odrzucona, ponieważ kolejka była pełna. Źródło danych.",
    "ru": "Мы исправили сортировку и добавили проверку. Поиск находит старую версию каталога.",
    "ja": "検索結果の順位が正しくありません。設定ファイルの値を確認してください。",
    "zh": "旧的索引会在重启之后删除。请不要修改这个目录中的文件。图中缺少对该模块的引用。",
    "el": "Ο δείκτης δεν άλλαξε μετά τη δοκιμή.",
    "vi": "Ý kiến: bộ đệm này quá nhỏ, hãy tăng lên. Tên tệp không đổi.",
    "signs": "At most 20 × 30 and 280 °C, 5 € → “batch first” – it’s 17 µs² ¼ ± 3 © ® § ¶ ¬ ¤ Ø",
    "tree": "repo/\n├── src/\n│   ├── a.go\n│   └── b.ts\n└── pkg/\n┌─┬─┐\n│ │ │\n└─┴─┘\n╔══╗\n║  ║\n╚══╝",
    "caps": "A MAÇÃ É SÓ UM NOME; NÃO HÁ ALTERAÇÕES. CZĘŚĆ ŻĄDAŃ. ВСЁ ЕЩЁ РАБОТАЕТ. GRÖSSE ÄNDERN, CÔTÉ",
    "names": "Ðorđe Ñuño á la Ångström, Íslenska: þetta er ekki villa, Ðað er nafn. Âme, âge et Âpre.",
    "quoted": "With the wrong charset, `é` shows up as `Ã©` and `’` as `â€™`; U+FFFD is `�`.",
    "refs": "caf&eacute; &amp; &lt;b&gt; &#233; &nbsp; &#8364; &copy;",
    "code": "func f() { return a & b; } // x && y",
}


@pytest.mark.parametrize("name", SAMPLES)
def test_sound_text_is_clean(name):
    assert repair(SAMPLES[name]) == (False, None)


def misread(text, page):
    out = []
    for b in text.encode():
        try:
            out.append(bytes([b]).decode(page))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.mark.parametrize("page", ["latin-1", "cp1252", "cp1250", "cp1251", "cp437", "cp850", "mac_roman"])
@pytest.mark.parametrize("name", ["de", "fr", "es", "pt", "sv"])
def test_utf8_read_as_a_page(name, page):
    """Whole texts and one sentence among sound ones come back exactly."""
    text = SAMPLES[name]
    assert repair(misread(text, page)) == (True, text)
    sound = "A plain sentence before.\n\n"
    assert repair(sound + misread(text, page) + "\nAnd after.") == (True, sound + text + "\nAnd after.")


@pytest.mark.parametrize("name", ["pl", "ru", "ja", "zh"])
def test_other_scripts(name):
    text = SAMPLES[name]
    assert repair(misread(text, "cp1252")) == (True, text)
    assert repair(misread(text, "latin-1")) == (True, text)


@pytest.mark.parametrize("name", ["de", "fr", "pl", "ru"])
def test_garbled_twice_and_as_references(name):
    text = SAMPLES[name]
    once = misread(text, "cp1252")
    assert repair(misread(once, "cp1252")) == (True, text)
    refs = "".join(c if ord(c) < 128 else f"&#{ord(c)};" for c in once)
    assert repair(refs) == (True, text)


@pytest.mark.parametrize("written,read,name", [("cp1251", "latin-1", "ru"), ("cp1251", "cp866", "ru"), ("koi8_r", "cp1251", "ru"), ("cp932", "cp1252", "ja"), ("cp932", "latin-1", "ja"), ("euc_jp", "latin-1", "ja"), ("gbk", "latin-1", "zh"), ("gbk", "big5", "zh"), ("cp1250", "cp1252", "pl"), ("iso8859_2", "latin-1", "pl")])
def test_legacy_text_read_as_another_page(written, read, name):
    raw = SAMPLES[name].encode(written)
    if read == "cp1252":
        text = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in raw)
    else:
        text = raw.decode(read, "replace")
    found, restored = repair(text)
    assert found
    if "�" not in text:
        assert restored == SAMPLES[name]


def test_what_cannot_be_restored_is_found():
    assert repair("La b�squeda encontr� 3 se�ales") == (True, None)
    assert repair("don\x92t") == (True, None) and repair("lines:\nâââ pkg/")[0] and repair("Die Ãbersicht zeigt")[0]
    assert repair(misread(SAMPLES["fr"], "cp1252").lower())[0]
    assert repair("Donât rename it â itâs part")[0] and repair("un port Ã partir de 10Â km")[0]
    assert repair("") == (False, None)


def test_garbled_as_often_as_you_like():
    text = once = SAMPLES["de"]
    for n in range(1, 8):
        once = misread(once, "cp1252")
        assert repair(once) == (True, text), n


def test_quotes_of_any_length():
    quote = "So sieht es falsch aus: `" + misread(SAMPLES["de"] * 5, "cp1252").replace("`", "") + "` – und so bleibt es."
    assert repair(quote) == (False, None)
    bad = misread("Größe", "cp1252")
    assert repair(f"`{bad}` steht für {bad}") == (True, f"`{bad}` steht für Größe")
    assert repair("\x007\x00 " + bad) == (True, "\x007\x00 Größe")


@pytest.mark.parametrize("page,least", [("cp1252", 0.99), ("latin-1", 0.99), ("cp1250", 0.97), ("cp1251", 0.98), ("cp437", 0.97), ("cp850", 0.97), ("mac_roman", 0.97)])
def test_restored_texts_equal_the_originals(page, least):
    """Sound documents of the tables, garbled whole under each page."""
    import duckdb

    texts = duckdb.sql("SELECT DISTINCT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE length(text) < 4000").fetchall()
    texts = sorted(t for (t,) in texts if t and not t.isascii() and "`" not in t and repair(t) == (False, None))[:250]
    same = sum(repair(misread(t, page)) == (True, t) for t in texts)
    print(page, len(texts), round(same / len(texts), 4))
    assert len(texts) > 100 and same / len(texts) >= least


def test_ways():
    assert judged(misread(SAMPLES["de"], "cp1252"))[0] == "spans" and judged("La b�squeda")[0] == "remains" and judged(SAMPLES["ru"].encode("cp1251").decode("latin-1"))[0] == "letters"
    assert judged("sound") == (None, None)


def test_very_long_text():
    text = SAMPLES["de"] * 3000
    assert repair(misread(text, "cp1252")) == (True, text)
    assert repair(text) == (False, None) and repair("x&" * 200_000) == (False, None)


def test_random_sound_latin_text_stays():
    rng = random.Random(4)
    for _ in range(300):
        words = ["".join(rng.choice("bcdfglmnrst") + rng.choice("aeiouaeiouäöüéèêçñãõåøæ") for _ in range(rng.randint(1, 5))) for _ in range(40)]
        text = "".join(w + rng.choice([" ", " ", ", ", ". ", " « ", " » ", "\xa0»", " – ", "”", "’", " 5° "]) for w in words)
        assert repair(text) == (False, None), text


def test_table_cases(spark):
    bad = misread(SAMPLES["de"], "cp1252")
    rows = [(1, bad, "x"), (2, None, "x"), (3, "", "x"), (4, SAMPLES["ru"], "x"), (5, bad, "x"), (5, bad, None), (None, bad, "x"), (7, "a�", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, restored string")
    got = sorted(((r.doc_id, r.restored) for r in garbled(df).collect()), key=str)
    assert got == sorted([(1, SAMPLES["de"]), (5, SAMPLES["de"]), (5, SAMPLES["de"]), (None, SAMPLES["de"]), (7, None)], key=str)
    assert garbled(df.filter("false")).count() == 0
