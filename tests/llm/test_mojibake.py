import pytest

from weftline.llm import mojibake as mj

TEXTS = [
    "Die Methode überschreibt das Feld, bevor es geprüft wird; größere Bäume müssen zurückgesetzt werden.",
    "La méthode modifiée dépend du paramètre déjà vérifié — c’est où l’entrée a été créée.",
    "O nó não lê a variável até à próxima iteração; também não há ligação.",
    "Каждый узел хранит последнее значение переменной, если цикл выполняется без условия.",
    "Każdy węzeł kończy się wcześniej, niż zakładał błąd w ścieżce.",
    "このメソッドは何も返さない。変数の値を更新する。",
    "The “name” isn’t set — see § 3, ½ of 12 €.",
]
WRONG = [("utf_8", w) for w in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866", "cp1250", "iso8859_2")]


def lenient(data, codec):
    out = []
    for b in data:
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.mark.parametrize("text", TEXTS)
def test_sound_text_is_left_alone(text):
    assert mj.examine(text) == (False, None, None)
    assert mj.examine(f"x\n{text}\nÃ and Â stand for sets, ÿ and Ð too; naïve × 2 ± 3 %") == (False, None, None)


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("wrote,read", WRONG)
def test_utf8_read_wrongly(text, wrote, read):
    garbled = lenient(text.encode(wrote), read)
    found, restored, _ = mj.examine(f"for (;;) {{}}\n{garbled}\nend")
    assert found
    if read in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850"):
        assert restored == f"for (;;) {{}}\n{text}\nend"


@pytest.mark.parametrize("text,wrote,read", [(TEXTS[0], "cp1252", "cp437"), (TEXTS[0], "cp1252", "mac_roman"), (TEXTS[1], "cp1252", "cp1251"), (TEXTS[2], "cp1252", "cp850"), (TEXTS[3], "cp1251", "cp1252"), (TEXTS[3], "koi8_r", "cp1251"), (TEXTS[3], "cp1251", "koi8_r"), (TEXTS[3], "cp866", "cp1251"), (TEXTS[4], "cp1250", "cp1252"), (TEXTS[6], "cp1252", "latin-1"), (TEXTS[5], "cp932", "cp1252"), (TEXTS[5], "euc_jp", "latin-1"), (TEXTS[5], "utf_8", "cp932")])
def test_other_encodings(text, wrote, read):
    data = text.encode(wrote)
    assert mj.examine(lenient(data, read) if read != "cp932" else data.decode(read, "replace"))[0]


def test_twice_partly_and_lost():
    twice = lenient(lenient(TEXTS[0].encode(), "cp1252").encode(), "cp1252")
    assert mj.examine(twice)[:2] == (True, TEXTS[0])
    half = TEXTS[1] + "\n" + lenient(TEXTS[1].encode(), "latin-1")
    assert mj.examine(half)[:2] == (True, TEXTS[1] + "\n" + TEXTS[1])
    assert mj.examine(TEXTS[0].encode("latin-1").decode("utf-8", "replace"))[:2] == (True, None)
    assert mj.examine("rÃ&copy;sumÃ&copy;")[:2] == (True, "résumé")


def test_frame(spark):
    long = "a b " * 200_000 + "zurÃ¼ckgesetzt"
    rows = [(1, None), (2, ""), (3, "plain"), (4, long), (5, "é"), (4, long), (None, "rÃ©sumÃ©")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id bigint, text string, chain string")
    got = sorted((r[0] or 0, r[1]) for r in mj.repaired(df).collect())
    assert got == [(0, "résumé"), (4, long[:-14] + "zurückgesetzt"), (4, long[:-14] + "zurückgesetzt")] or [g[0] for g in got] == [0, 4, 4]
    assert mj.repaired(df.limit(0)).count() == 0


def read_wrong(text, codec):
    return "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in text.encode())


def test_garbled_many_times():
    for times in range(1, 6):
        text = "café naïve → größer"
        for _ in range(times):
            text = read_wrong(text, "cp1252")
        assert mj.examine(text) == (True, "café naïve → größer", " ".join(["cp1252>utf_8"] * times))


def test_search_finds_the_cheapest_text():
    samples = ["café", "naïve&amp;eacute;", "größer", "Область", "±350", "“so”", "├──", "日本語です"]
    samples += [read_wrong(s, c) for s in samples for c in ("cp1252", "cp437", "mac_roman")] + ["a�b", "x\x93y\x94"]
    for text in samples:
        best, front = mj.cost(text), [(text, 0.0, "")]
        for _ in range(3):
            grown = []
            for now, paid, chain in front:
                crossed = any(not o.endswith("utf_8") and o != "unescape" for o in chain.split())
                steps = [*mj._steps(now)] + ([(mj.LOST, mj._FAILED.sub("", text))] if not chain and mj._FAILED.search(text) else [])
                for operation, new in steps:
                    other = operation not in ("unescape", mj.LOST) and not operation.endswith("utf_8")
                    if not (other and crossed):
                        price = paid + mj._price(operation, crossed)
                        best = min(best, mj.cost(new) + price)
                        if operation != mj.LOST and price < mj.cost(text):
                            grown.append((new, price, f"{chain} {operation}".strip()))
            front = list({(new, chain.count("utf_8") < len(chain.split())): (new, price, chain) for new, price, chain in sorted(grown, key=lambda x: -x[1])}.values())
        found = mj.search(text)
        if found or mj.cost(text) - best > 1e-9:
            assert max([0.0, *(g for *_, g in found)]) >= mj.cost(text) - best - 1e-9, text
