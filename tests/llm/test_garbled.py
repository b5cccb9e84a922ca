import pytest

from quillspark.llm import garbled as G

TEXTS = {
    "en": ["The café chain’s résumé says “naïve” – it costs £50 or €60… and more.", "We don’t ask for fiancé visas — curiosity is enough, 25 °C.", "The façade hid 9 services • it fell by half.", "CHÂTEAU ÂGÉ, À CÔTÉ DE L’ÎLE"],
    "de": ["Außerdem betreute ich die nächtlichen Läufe für größere Kunden.", "Führte ein Team von 5 Fachkräften durch die Übergabe.", "Zuständig für Qualitätssicherung in „Obni“ und Verfügbarkeit."],
    "ru": ["Руководил группой из пяти инженеров и подготовил отчёты.", "Требуется опыт работы и внимание к деталям.", "Проект вырос до многих пользователей."],
    "pl": ["Kierował zespołem w łódzkim oddziale służby zdrowia.", "Źródła danych zostały przejrzane i opisane, wymagana znajomość.", "Zaprojektował moduł i skrócił opóźnienia."],
    "ja": ["品質管理の資格を取得しました。", "経験がある方を歓迎します。報告書の作成を担当しました。", "検査工程を設計し、障害を削減しました。"],
    "es": ["Diseñó el módulo y redujo los errores; título de ingeniería.", "La compañía creció con años de práctica, mención por el diseño más útil."],
    "pt": ["Atuação em São Lindaro com manutenção. Também automatizo relatórios.", "AÇÃO, GESTÃO E INOVAÇÃO EM FORMAÇÃO E CERTIFICAÇÃO", "Não exige experiência, só dedicação."],
}


@pytest.fixture(scope="module")
def model():
    return G.train({lang: texts * 3 for lang, texts in TEXTS.items()})


def test_clean_texts_stay(model):
    for texts in TEXTS.values():
        for t in texts:
            assert model.restore(t) is None, t
    assert model.restore("Rated 4/9, no accents") is None


@pytest.mark.parametrize("right,wrong,langs", [("utf-8", "cp1252", "en de es pt"), ("utf-8", "latin-1", "en de ru pl ja es pt"), ("utf-8", "cp1251", "en de es pt"), ("utf-8", "cp437", "en de es pt ru"), ("utf-8", "mac_roman", "en de es pt ru"), ("cp1252", "cp437", "es de"), ("cp1252", "mac_roman", "de es"), ("cp1251", "cp1252", "ru"), ("koi8_r", "latin-1", "ru"), ("cp1250", "latin-1", "pl"), ("shift_jis", "latin-1", "ja")])
def test_round_trips(model, right, wrong, langs):
    done = total = 0
    for lang in langs.split():
        for t in TEXTS[lang]:
            try:
                bad = t.encode(right).decode(wrong)
            except UnicodeError:
                continue
            total += 1
            got = model.restore("Plain start.\n" + bad)
            done += got is not None and got[0] == "Plain start.\n" + t and got[2]
    assert total and done >= 0.75 * total, (done, total)


def test_twice_and_in_part_and_lost(model):
    t = TEXTS["en"][0]
    twice = t.encode().decode("latin-1").encode().decode("latin-1")
    assert model.restore(twice)[0] == t
    part = TEXTS["en"][1] + "\n" + t.encode().decode("latin-1")
    assert model.restore(part)[0] == TEXTS["en"][1] + "\n" + t
    lost = model.restore("The caf� closed")
    assert lost[0] == "The caf� closed" and lost[1] == [] and not lost[2]


def test_garbled_many_times(model):
    for text in (TEXTS["en"][0], TEXTS["de"][0]):
        bad = text
        for _ in range(5):
            bad = bad.encode().decode("latin-1")
        assert model.restore(bad)[0] == text and len(model.restore(bad)[1]) == 5


def test_table(spark):
    ddl = "doc_id bigint, text string, lang string, chains string"
    rows = [(i * 10 + k, t, lang, None) for i, (lang, ts) in enumerate(TEXTS.items()) for k, t in enumerate(ts * 2)]
    bad = TEXTS["de"][0].encode().decode("latin-1")
    rows += [(900, bad, "en", None), (900, bad, "en", None), (901, None, "en", None), (902, "", None, None), (903, "ascii", "xx", None), (None, bad, None, None), (904, "x� " * 20000, None, None)]
    out = {r.doc_id: r for r in G.restore_texts(spark.createDataFrame(rows, ddl), "doc_id", "text", "lang").collect()}
    assert set(out) == {900, 904} and out[900].restored == TEXTS["de"][0] and out[900].complete and not out[904].complete
    assert G.restore_texts(spark.createDataFrame([], ddl), "doc_id", "text", "lang").count() == 0
    assert G.restore_texts(spark.createDataFrame([(1, "caf�", None, None)], ddl), "doc_id", "text", "lang").count() == 1


ENDS = ["Merrow Logistics, Grünhafen.", "Die École in Österreich, 7 Ärzte.", "Il part dès l’été.", "Überfast?"]


@pytest.fixture(scope="module")
def lettered():
    texts = TEXTS["de"] + TEXTS["en"] + TEXTS["es"]
    return G.train({"de": [f"{t} {end}" for t in texts for end in ENDS] * 10, "pl": [f"{t} Zielona Góra." for t in TEXTS["pl"]] * 40})


def test_accepted_chain_is_undone_everywhere(lettered):
    clean = "\n".join([*TEXTS["de"], "Xqvw 4711 Zzyzx Kwrtl, Grünhafen."])
    assert lettered.restore(clean) is None
    got = lettered.restore(clean.replace("„", "").replace("“", "").encode("cp1252").decode("mac_roman"))
    assert got[0] == clean.replace("„", "").replace("“", "")


@pytest.mark.parametrize("wrong,end", [("mac_roman", ENDS[0]), ("cp437", ENDS[0]), ("mac_roman", ENDS[3]), ("cp850", ENDS[3])])
def test_one_letter_wins(lettered, wrong, end):
    assert lettered.restore("Plain start. " + end.encode("cp1252").decode(wrong))[0] == "Plain start. " + end


def test_usual_letters_beside_garbled_ones(lettered):
    assert lettered.restore("Il part dès lâ€™été.")[0] == ENDS[2]


def test_letters_count_in_whole_texts(spark):
    """Rare capitals that stand beyond the sampled part of the texts only."""
    long = "Plain filler without accents. " * 100
    rows = [(k, f"{TEXTS['de'][k % 3]} {long}{end}", "de") for k, end in enumerate(["Österreich wächst.", "Ärzte gesucht.", "École d’été."] * 40)]
    rows += [(900 + k, end.encode().decode("cp1252", "ignore"), "de") for k, end in enumerate(["Österreich wächst.", "Ärzte gesucht.", "École d’été."])]
    out = {r.doc_id: r.restored for r in G.restore_texts(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "doc_id", "text", "lang").collect()}
    assert out == {900: "Österreich wächst.", 901: "Ärzte gesucht.", 902: "École d’été."}


def test_dictionaries_are_made_from_all_texts(spark, monkeypatch):
    """Sentences that stand beyond a text's first thousands of characters, in every text of a large language and in every language, are all counted."""
    made, init = [], G.Model.__init__
    monkeypatch.setattr(G.Model, "__init__", lambda self, dictionaries, usual: made.append(dictionaries) or init(self, dictionaries, usual))
    late = [f"Später folgte die große Prüfung {a}{b} für Kläranlagen." for a in "QWXYZ" for b in "QWXYZ"]
    filler = "Plain filler without accents. " * 100
    rows = [(k, f"{filler}{late[k % 25]}", "de") for k in range(100)]
    codes = [a + b for a in "qwxyz" for b in "abcdefghij"]
    rows += [(1000 + 10 * i + k, f"Die schöne Übersicht {code}{code}{code} über alle Länder.", code) for i, code in enumerate(codes) for k in range(3)]
    G.restore_texts(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "doc_id", "text", "lang")
    pieces = {s.encode()[i : i + G.PIECE] for s in late for i in range(len(s.encode()) - G.PIECE + 1)}
    assert [p for p in pieces if p not in made[0]["de"]] == []
    assert set(made[0]) == {"de", *codes}


def test_pieces_are_counted_exactly():
    """The distributed counts' building block against plain counting, and a choice that takes the most frequent stretch first."""
    segments = [("Außen größer als innen".encode(), 3), ("größer".encode(), 2), (b"\xc3\xbc", 9), ("Maß, größer als".encode(), 1)]
    total = G.np.zeros(2**G.COUNTER_BITS, G.np.int64)
    G.count_pieces(total, segments, "de")
    plain: dict[bytes, int] = {}
    for s, n in segments:
        for i in range(len(s) - G.PIECE + 1):
            plain[s[i : i + G.PIECE]] = plain.get(s[i : i + G.PIECE], 0) + n
    assert {p: int(total[G._pieces(p, "de")[0]]) for p in plain} == plain and total.sum() == sum(plain.values())
    counters = G.np.flatnonzero(total)
    chosen = G.choose([s for s, _ in segments], "de", counters, total[counters])
    assert all(any(p in c for c in chosen) for p in plain)
    assert G.choose([], "de", counters, total[counters]) == [] == G.choose([b"x"], "de", counters[:0], total[:0])
