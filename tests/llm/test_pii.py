import pytest

from corpusmill.llm import pii

WORDS = [("凪沢", "surname"), ("史織", "given"), ("鈴掛", "surname"), ("仝", "surname"), ("听澜", "given"), ("Dastrel", "surname"), ("Corwyn", "given"), ("Kotohano", "given"), ("Nagisawa", "surname"), (None, "surname"), ("工房", "noun")]

CASES = [
    ("メールはshiori.vick7@mail.exampleに届きます。", [("EMAIL", "shiori.vick7@mail.example")]),
    ("連絡 wynnet＠post.kasumi.example まで", [("EMAIL", "wynnet＠post.kasumi.example")]),
    ("有事请发到a-b+shop(at)youxiang dot example或拨打121-3291-8595。", [("EMAIL", "a-b+shop(at)youxiang dot example"), ("PHONE", "121-3291-8595")]),
    ("問い合わせはx_y [at] tegami.testまたは０７０－０７７８－７１７７まで", [("EMAIL", "x_y [at] tegami.test"), ("PHONE", "０７０－０７７８－７１７７")]),
    ("@kel_dor をフォローしてください。", []),
    ("[EMAIL] に送ってください。", []),
    ("電話(03) 0683-4121)25個", [("PHONE", "(03) 0683-4121")]),
    ("Call +44 7700 900681 or 409.555.0110 or (409) 555-0110.", [("PHONE", "+44 7700 900681"), ("PHONE", "409.555.0110"), ("PHONE", "(409) 555-0110")]),
    ("让我们回电+86 121 5106 7087。电话010-08176346", [("PHONE", "+86 121 5106 7087"), ("PHONE", "010-08176346")]),
    ("注文番号 20494052-4027 は発送済み。型番 KX-6573-7725、コード 5346 1115 8663 1702 6234、订单号 22975882615169638279、品番 693949091935A", []),
    ("マイナンバー 1045-2259-4114 を控えた", [("ID_NUMBER", "1045-2259-4114")]),
    ("身份证号99732519761003064X，请核对。身份证：993713 19501116 5589", [("ID_NUMBER", "99732519761003064X"), ("ID_NUMBER", "993713 19501116 5589")]),
    ("SSN 994 53 9101 was left; ID no. 911-15-5399, holder Corwyn Dastrel.", [("ID_NUMBER", "994 53 9101"), ("ID_NUMBER", "911-15-5399"), ("NAME", "Corwyn Dastrel")]),
    ("住所は霧原県鈴掛町柳小路5-7-16です。", [("ADDRESS", "霧原県鈴掛町柳小路5-7-16")]),
    ("引っ越し先:潮音市南桜町839番地 青柳マンション804(電話08008948971)", [("ADDRESS", "潮音市南桜町839番地 青柳マンション804"), ("PHONE", "08008948971")]),
    ("我家地址是青泽省棠浦市柳塘区槐影街310号。搬到了砚山市东屿区听雨路159号20栋140室。", [("ADDRESS", "青泽省棠浦市柳塘区槐影街310号"), ("ADDRESS", "砚山市东屿区听雨路159号20栋140室")]),
    ("I live at Flat 4, 147 Larkmere Lane, Dunmarrow ZQ2 1XX now.", [("ADDRESS", "Flat 4, 147 Larkmere Lane, Dunmarrow ZQ2 1XX")]),
    ("担当の凪沢　史織様が090-0402-6335でお待ちです。", [("NAME", "凪沢　史織"), ("PHONE", "090-0402-6335")]),
    ("氏名:霧坂こはる 連絡先:090-0300-4951", [("NAME", "霧坂こはる"), ("PHONE", "090-0300-4951")]),
    ("アヤハシ・スミネさん(b@mail.example)から返事", [("NAME", "アヤハシ・スミネ"), ("EMAIL", "b@mail.example")]),
    ("联系人仝听澜先生，手机12654857300。昨天郄青砚到店里来", [("NAME", "仝听澜"), ("PHONE", "12654857300"), ("NAME", "郄青砚")]),
    ("姓名：夔砚舟 电话：127 3057 3445。", [("NAME", "夔砚舟"), ("PHONE", "127 3057 3445")]),
    ("Dastrel, Corwyn moved to 17 Old Windle Street, Winfold. Mr. C. Dastrel replied from a@b.example", [("NAME", "Dastrel, Corwyn"), ("ADDRESS", "17 Old Windle Street, Winfold"), ("NAME", "C. Dastrel"), ("EMAIL", "a@b.example")]),
    ("Kotohano Nagisawa先生の研究室は移りました。", [("NAME", "Kotohano Nagisawa")]),
    ("鈴掛町三丁目のバス停。凪沢書店で買った。仝记面馆一碗41元。The Dastrel Bookshop opens at 8. お疲れ様でした。皆さんは", []),
    ("更新 2031-06-19 版 v8.18.1、版本 v4.12.3，2031-03-15", []),
    (None, []),
    ("", []),
]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_findings(text, expected):
    lex = pii.Lexicon(WORDS)
    found = pii.find([text], lex)[0]
    assert [(k, text[s:e]) for k, s, e in found] == expected
    if text:
        clean = pii.redact(text, found)
        assert clean.count("[") - text.count("[") == sum(1 - x[1].count("[") for x in expected)


UNITS = [
    ("届け先は東京都新宿区西新宿2-8-1です。", ["東京都新宿区西新宿2-8-1"]),
    ("住まいは東京都西新宿2-8-1だ。", ["東京都西新宿2-8-1"]),
    ("宛先:北海道虻田郡留寿都村12-3まで。", ["北海道虻田郡留寿都村12-3"]),
    ("引っ越し先は檜原村467-1、実家は中野区中野4-8-1。", ["檜原村467-1", "中野区中野4-8-1"]),
    ("彼は鈴村2-1で勝ち、この地区3-4は鉄道5-6に近い。", []),
    ("我住在柳塘区槐影街310号。", ["柳塘区槐影街310号"]),
]


@pytest.mark.parametrize(("text", "expected"), UNITS)
def test_addresses_of_every_unit(text, expected):
    found = pii.find([text], pii.Lexicon([*WORDS, ("鈴村", "surname")]))[0]
    assert [(k, text[s:e]) for k, s, e in found] == [("ADDRESS", x) for x in expected]


PLAIN = [
    ("Please forward this to Maria Gonzalez tomorrow.", [("NAME", "Maria Gonzalez")]),
    ("Sincerely,\nMaria Gonzalez", [("NAME", "Maria Gonzalez")]),
    ("My name is Anna Schmidt", [("NAME", "Anna Schmidt")]),
    ("From: Robert Chen", [("NAME", "Robert Chen")]),
    ("I met with Priya Raman", [("NAME", "Priya Raman")]),
    ("Dr. Jane Miller called yesterday.", [("NAME", "Jane Miller")]),
    ("田中太郎と申します。", [("NAME", "田中太郎")]),
    ("山田花子です。", [("NAME", "山田花子")]),
    ("佐藤さんに連絡してください。", [("NAME", "佐藤")]),
    ("我叫王小明", [("NAME", "王小明")]),
    ("李明先生的电话是13912345678。", [("NAME", "李明"), ("PHONE", "13912345678")]),
    ("+33 1 23 45 67 89", [("PHONE", "+33 1 23 45 67 89")]),
    ("020 7946 0958", [("PHONE", "020 7946 0958")]),
    ("1-800-555-0199", [("PHONE", "1-800-555-0199")]),
    ("tel:5551234567", [("PHONE", "5551234567")]),
    ("Call me at (212) 555-0147.", [("PHONE", "(212) 555-0147")]),
    ("jane at example dot com", [("EMAIL", "jane at example dot com")]),
    ("mailto:jane@example.org", [("EMAIL", "jane@example.org")]),
    ("passport number AB1234567", [("ID_NUMBER", "AB1234567")]),
    ("IBAN DE89 3704 0044 0532 0130 00", [("ID_NUMBER", "DE89 3704 0044 0532 0130 00")]),
    ("GB29NWBK60161331926819 is my account", [("ID_NUMBER", "GB29NWBK60161331926819")]),
    ("NINO QQ123456C", [("ID_NUMBER", "QQ123456C")]),
    ("12 Elm St., Springfield", [("ADDRESS", "12 Elm St., Springfield")]),
    ("1600 Pennsylvania Ave NW", [("ADDRESS", "1600 Pennsylvania Ave NW")]),
    ("350 Fifth Avenue, Suite 3300, New York", [("ADDRESS", "350 Fifth Avenue, Suite 3300, New York")]),
    ("Musterstraße 12, 10115 Berlin", [("ADDRESS", "Musterstraße 12, 10115 Berlin")]),
    ("東京都千代田区丸の内1-1-1", [("ADDRESS", "東京都千代田区丸の内1-1-1")]),
    ("大阪府大阪市北区梅田1丁目2-3", [("ADDRESS", "大阪府大阪市北区梅田1丁目2-3")]),
    ("北京市朝阳区建国路88号", [("ADDRESS", "北京市朝阳区建国路88号")]),
]
NOTHING = [
    "The New York office will open at 8 on Monday. He moved on. Nothing replied.",
    "東京です。学生です。田中町です。この商品は石油製品です。私は学生です。",
    "我是老师。我叫了一辆车。我是中国人。搬家以后，马春问题的颜色。",
    "From: Monday to Friday. To: Be Or Not",
    "お客様が来ました。皆様へ。お母さんが来た。猫が来た。昨日荷物が来た。返事が来るまで電話を待つ。",
    "version 10.2.33.4567 of 2031-06-19 10:22, 部品番号 AB12 3456 7890 1234 5678",
]


@pytest.mark.parametrize(("text", "expected"), PLAIN)
def test_sentences_unlike_the_tables(text, expected):
    found = pii.find([text], pii.Lexicon(WORDS))[0]
    assert [(k, text[s:e]) for k, s, e in found] == expected


@pytest.mark.parametrize("text", NOTHING)
def test_sentences_without_personal_data(text):
    assert pii.find([text], pii.Lexicon(WORDS))[0] == []


def test_batches_do_not_run_into_each_other():
    lex = pii.Lexicon(WORDS)
    texts = [t for t, _ in CASES]
    assert pii.find(texts, lex) == [pii.find([t], lex)[0] for t in texts]


@pytest.mark.parametrize("extra", [False, True])
def test_tables(make, extra):
    rows = [{"doc_id": i, "text": t} for i, (t, _) in enumerate(CASES)]
    rows += rows[:4] + [{"doc_id": None, "text": CASES[0][0]}, {"doc_id": 500, "text": "字" * 1_200_000 + "。" + CASES[0][0]}]
    lexicon = make("lexicon", [(w, k, None, None) for w, k in WORDS] * 2, extra)
    got = {tuple(r) for r in pii.find_personal(make("documents", rows, extra), lexicon).collect()}
    expected = set()
    for i, (t, found) in enumerate(CASES):
        at = 0
        for kind, s in found:
            at = t.index(s, at)
            expected.add((i, kind, at, at + len(s)))
            at += len(s)
    start = 1_200_001 + CASES[0][0].index("shiori")
    expected.add((500, "EMAIL", start, start + len(CASES[0][1][0][1])))
    assert got == expected
    clean = pii.redact_personal(make("documents", rows, extra), lexicon).collect()
    assert len(clean) == len(rows) and sum(r["replaced"] for r in clean if r["doc_id"] == 0) == 2


def test_empty_tables(make):
    assert pii.find_personal(make("documents", []), make("lexicon", [])).collect() == []
    assert pii.redact_personal(make("documents", []), make("lexicon", [])).collect() == []
    got = pii.find_personal(make("documents", [{"doc_id": 1, "text": CASES[0][0]}]), make("lexicon", [])).collect()
    assert [r["pii_type"] for r in got] == ["EMAIL"]
