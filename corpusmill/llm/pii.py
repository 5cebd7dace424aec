"""Problem 8: personal information inside free text.

Anchor expansion. An Aho-Corasick automaton over each batch finds the anchors: at-signs in any spelling, titles and
phrases that stand beside names, words of the name lexicon, units of addresses and identifier cues; chains of digits
are anchors of their own. At each anchor a deterministic local parser looks a bounded distance to both sides, decides
where the address, number or name begins and ends, and rejects what only looks alike: order, part and card numbers,
handles, placeholders, and names that are part of an e-mail address or of a company, shop or place name.

Texts are read where they lie and nothing is shuffled. Positions are code points of the original text; width variants
are unified one to one beforehand, so offsets hold.

Defined cases: null and empty texts give no rows and null or empty redactions; a repeated ``doc_id`` is read like any
other row and equal findings of equal rows come out once; a null ``doc_id`` is left out of the findings; a null or
partly null lexicon only weakens the name parser; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

TYPES = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")
#: Lexicon rows sent to the tasks; a larger lexicon is refused, not cut.
LEXICON_ROWS = 1_000_000

_HAN = r"㐀-䶿一-鿿豈-﫿々〆"
_KATA = r"ァ-ヺー"
_HIRA = r"ぁ-ゖ"

# Words that announce a name, titles that follow one, verbs of persons, words that are no names.
BEFORE_NAME = (
    "氏名:", "名前:", "姓名:", "投稿者】", "発信者】", "差出人】", "发帖人】", "发件人】", "差出人:", "宛名:", "発信者:", "投稿者:", "担当:", "担当の", "担当者:", "代表者:", "私は", "私の名前は",
    "联系人", "联系人:", "发件人:", "收件人:", "负责人:", "我叫", "我是", "名叫", "我的名字是", "name:", "name is ", "from:", "to:", "attn:", "cc:", "signed by ", "ask for ", "speak to ", "speak with ", "talk to ", "met with ", "meeting with ",
    "forward this to ", "sent to ", "written by ", "attention ", "attn ", "holder ", "holder: ", "c/o ", "mr. ", "mrs. ", "ms. ", "dr. ", "prof. ", "mr ", "mrs ", "ms ", "dr ", "prof ", "contact ", "dear ",
    "sincerely,\n", "sincerely\n", "regards,\n", "regards\n", "best,\n", "thanks,\n",
)
#: Of these what follows must look like a name by a known part or by two capitalised words.
WEAK_BEFORE = ("私は", "我是", "我叫", "名叫", "from:", "to:", "cc:", "contact ", "dear ", "sent to ", "speak to ", "speak with ", "talk to ", "met with ", "meeting with ", "担当:", "forward this to ", "best,\n", "thanks,\n", "regards\n", "sincerely\n", "written by ")
HONORIFICS = ("さん", "様", "氏", "先生", "老师", "女士", "小姐", "と申します", "と申し", "と言います", "といいます", "です", "收。", "收\n", "收\0", "收\r", "收，")
#: What stands behind a title that belongs to a name, where the name itself is not known.
AFTER_TITLE = {"さん": ("(", "から", "宛", "へ", "の電話"), "様": ("が", "宛", "から", "でお待", "("), "氏": ("は", "が", "("), "先生": ("の", ",", "(", "到", "的", "，"), "老师": ("的", "(", "，"), "女士": ("(", "，", "的"), "小姐": ("(", "，", "的"), "と申します": ("",), "と申し": ("",), "と言います": ("",), "といいます": ("",)}
PERSON_VERBS_EN = ("replied", "moved", "called", "wrote", "said", "says", "asked", "told", "answered", "phoned", "emailed", "lives", "lived", "works", "worked", "joined", "met", "signed", "confirmed", "agreed", "arrived", "visited", "ordered", "explained", "reported", "thanked", "writes")
LEAD_IN = ("担当の", "受付の", "昨日", "今日", "先日", "明日", "昨夜", "今朝", "先週", "昨天", "今天", "前天", "明天", "上周", "刚才", "联系人", "联系人:", "请联系", "请找", "私は", "我叫")
NOT_NAMES = ("The", "A", "An", "And", "Or", "Not", "Be", "To", "Of", "In", "On", "At", "For", "New", "Our", "Your", "My", "We", "You", "All", "This", "That", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday", "January", "February", "March", "April", "June", "July", "August", "September", "October", "November", "December", "Customer", "Team", "Support", "Service", "Sir", "Madam", "City", "United", "National", "International", "University", "Department", "Office")
COMMON_PERSONS = ("友人", "友達", "母", "父", "兄", "姉", "弟", "妹", "先生", "社長", "店長", "部長", "課長", "子供", "子ども", "客", "学生", "生徒", "警察", "医者", "同僚", "後輩", "先輩", "彼女", "彼", "私", "僕", "俺", "誰", "皆", "人", "老板", "客人", "朋友", "孩子", "同事", "老师", "学生", "警察", "医生", "他们", "我们", "你们", "大家", "有人", "邻居", "店员", "客户", "经理", "员工")
#: Common family names and given names, beside those of the lexicon.
SURNAMES_JA = ("佐藤", "鈴木", "高橋", "田中", "伊藤", "渡辺", "山本", "中村", "小林", "加藤", "吉田", "山田", "佐々木", "山口", "松本", "井上", "木村", "斎藤", "清水", "山崎", "阿部", "池田", "橋本", "山下", "石川", "中島", "前田", "藤田", "後藤", "小川", "岡田", "村上", "長谷川", "近藤", "石井", "坂本", "遠藤", "藤井", "青木", "西村", "福田", "太田", "三浦", "藤原", "岡本", "松田", "中川", "中野", "原田", "小野")
SURNAMES_ZH = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林罗高郑梁谢宋唐许邓韩冯曹彭曾肖田董潘袁蔡蒋余于杜叶程魏苏吕丁任卢姚沈钟姜崔谭陆范汪廖石金韦贾夏付方邹熊白孟秦邱侯江尹薛闫段雷龙黎史陶贺顾毛郝龚邵万钱严"
GIVEN_LATIN = ("James", "Mary", "Robert", "Patricia", "John", "Jennifer", "Michael", "Linda", "David", "Elizabeth", "William", "Barbara", "Richard", "Susan", "Joseph", "Jessica", "Thomas", "Sarah", "Charles", "Karen", "Daniel", "Nancy", "Matthew", "Lisa", "Anthony", "Betty", "Mark", "Sandra", "Paul", "Emily", "Steven", "Anna", "Andrew", "Maria", "Peter", "Laura", "George", "Julia", "Martin", "Eva", "Carlos", "Sofia", "Jose", "Ana", "Luis", "Elena", "Juan", "Marta", "Hans", "Klaus", "Pierre", "Marie", "Jean", "Priya", "Raj", "Amit", "Wei", "Yuki", "Kenji", "Olga", "Ivan", "Fatima", "Ahmed", "Mohammed", "Ali", "Jane", "Alice", "Kate", "Tom", "Ben", "Sam", "Emma", "Oliver", "Lucy", "Henry")
NOT_AFTER_SURNAME = ("町", "市", "県", "村", "区", "郡", "府", "書店", "商店", "商事", "食堂", "医院", "病院", "歯科", "工業", "製作所", "记", "記", "书店", "公司", "集团", "诊所", "超市", "株式会社", "有限公司", "駅", "橋", "台", "坂", "通り", "様式", "小学", "中学", "高校", "大学")
NOT_AFTER_LATIN = ("bookshop", "books", "ltd", "inc", "shop", "store", "street", "road", "lane", "avenue", "close", "row", "bakery", "cafe", "clinic", "hotel", "park", "station", "school", "bridge", "company", "group", "hall")
#: Words of identity numbers; the number stands close behind.
CUE_ID = ("パスポート", "passport", "护照", "nino", "national insurance", "iban", "driver license", "license number", "免許証", "マイナンバー", "個人番号", "身份证", "身份証", "ssn", "social security", "national id", "id number", "证件号", "旅券番号")
#: The only prefectures in 都 and 道; alone those letters end many other words.
PREFECTURES = ("東京都", "北海道")
NOT_PLACE = ("地区", "学区", "特区", "街区", "選挙区", "管区", "農村", "漁村", "山村")
STREET = ("street", "road", "lane", "avenue", "close", "row", "drive", "terrace", "way", "court", "square", "crescent", "boulevard", "place", "st.", "rd.", "ave.", "ave", "blvd.", "blvd", "dr.", "ln.")
#: Streets whose number follows the name.
STREET_DE = ("straße", "strasse", "str.", "gasse", "platz", "allee", "weg")
SCHEMES = ("mailto:", "tel:", "sms:", "callto:", "whatsapp:")

_EMAIL_RIGHT = re.compile(r"(?:\s?(?:\[at\]|\(at\)|@)\s?)([a-z0-9\-]+(?:(?:\.|\s?(?:\[dot\]|\(dot\))\s?|\sdot\s)[a-z0-9\-]+)+)", re.A)
_SPOKEN_LEFT = re.compile(r"(?:[a-z0-9][a-z0-9._+\-]* dot )?[a-z0-9][a-z0-9._+\-]*$", re.A)
_SPOKEN_RIGHT = re.compile(r" at ([a-z0-9\-]+(?: dot [a-z0-9\-]+)+)(?![a-z0-9])", re.A)
_EMAIL_LEFT = re.compile(r"[a-z0-9][a-z0-9._+\-]*\s?$", re.A)
_SEP = r"[-. ]"
_PHONE = re.compile(
    rf"(?:\+\d{{1,3}}{_SEP}?(?:\(0\){_SEP}?)?\d{{2,4}}(?:{_SEP}?\d{{3,4}}){{1,2}}"
    rf"|\(0\d{{1,4}}\){_SEP}?\d{{2,4}}{_SEP}?\d{{4}}"
    rf"|\(\d{{3}}\){_SEP}?\d{{3}}{_SEP}\d{{4}}"
    rf"|0[5-9]0{_SEP}?\d{{4}}{_SEP}?\d{{4}}"
    r"|0\d{1,3}-\d{2,4}-\d{4}"
    r"|0\d{2,3}[- ]\d{7,8}"
    rf"|1[2-9]\d{_SEP}?\d{{4}}{_SEP}?\d{{4}}"
    r"|0\d{4} \d{6}|0\d{3} \d{3} \d{4}"
    r"|[2-9]\d\d[-.]\d{3}[-.]\d{4}"
    rf"|\+\d{{1,3}}(?:{_SEP}?\d{{1,4}}){{3,6}}"
    r"|0\d{2} \d{4} \d{4}|0\d(?:[ .]\d{2}){4}|0\d{2,4}/\d{5,8}"
    r"|1[-. ][2-9]\d\d[-. ]\d{3}[-. ]\d{4}|1[-. ]?\([2-9]\d\d\) ?\d{3}[-. ]\d{4}"
    r"|(?:0120|0800|0570)-\d{2,3}-\d{3,4}|[48]00-\d{3,4}-\d{3,4})",
    re.A,
)
_ID_CN = re.compile(r"\d{6}[ -]?(?:19|20)\d{6}[ -]?\d{3}[0-9x]", re.A)
_ID_JP = re.compile(r"\d{4}([ -]?)\d{4}\1\d{4}", re.A)
_ID_US = re.compile(r"\d{3}([ -])\d\d\1\d{4}", re.A)
_ID_CUED = re.compile(r"[a-z]{0,3}\d[\d \-]{6,20}\d[x]?", re.A)
_TEL = re.compile(r"[+(]?\d[\d\-. ()]{5,18}\d", re.A)
_ID_LETTERS = re.compile(r"(?:[a-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[a-d]|[a-z]{1,3}\d{6,9}[a-z]?|\d{8,12}[a-z]?|[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){3,7}(?: ?[a-z0-9]{1,3})?)(?![a-z0-9])", re.A)
_CUE_GAP = re.compile(r"(?:number|no\b|is\b|was\b|番号|号码|[ :.#は是为の)])*", re.A)
_IBAN = re.compile(r"(?<![a-z0-9])[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){3,7}(?: ?[a-z0-9]{1,3})?(?![a-z0-9])", re.A)

_ZH_STOP = "是到了在往至于为的和与把向从寄给址"
_ZH_PLACE = rf"(?:(?![{_ZH_STOP}])[{_HAN}]){{2,4}}?"
_ADDRESS_ZH = re.compile(rf"(?:{_ZH_PLACE}(?:省|自治区))?(?:{_ZH_PLACE}市)?(?:{_ZH_PLACE}[区县])?(?:(?![{_ZH_STOP}])[{_HAN}]){{1,6}}?(?:路|街|巷|道|弄|胡同)\d+号(?:\d+(?:单元|栋|幢|号楼|座)\d*)?(?:\d*室|\d+)?")
_ADDRESS_JA = re.compile(rf"(?:[{_HAN}]{{1,4}}?[県府都道])?(?:[{_HAN}]{{1,5}}?[市区町村郡])?(?:[{_HAN}]{{1,5}}?[区町村])?[{_HAN}ノヶケツ之の]{{0,6}}?(?:\d+丁目(?:\d+番(?:地)?(?:\d+号?)?|\d+-\d+)?|\d+番地(?:の?\d+)?|\d+-\d+(?:-\d+)?)(?: ?[{_HAN}{_KATA}]{{2,12}} ?[a-z]?-?\d{{1,5}}(?:号室|号|室)?)?")
_ADDRESS_EN = re.compile(r"(?:(?:flat|apt\.?|apartment|unit|suite) \d+[a-z]?,? )?\d+[a-z]? (?:[a-z']+ ){1,3}$", re.A)
_ADDRESS_EN_TAIL = re.compile(r"(?: (?:N|S|E|W|NE|NW|SE|SW)\b)?(?:, (?:Suite|Apt\.?|Apartment|Unit|Floor|Room|Flat) \d+[A-Z]?)?(?:, [A-Z][a-z]+(?: [A-Z][a-z]+)?(?:,? [A-Z]{2} \d{5}(?:-\d{4})?| [A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2})?)?")
_STRASSE_LEFT = re.compile(r"(?:[A-ZÄÖÜ][a-zäöüß\-]+ )?[A-ZÄÖÜ]?[A-Za-zÄÖÜäöüß\-]*$")
_STRASSE_RIGHT = re.compile(r" \d+ ?[a-z]?(?![a-z0-9])(?:, \d{5} [A-ZÄÖÜ][a-zäöüß]+(?: [A-ZÄÖÜ][a-zäöüß]+)?)?")
_NAME_LATIN = re.compile(r"[A-Z][a-z]+, [A-Z](?:[a-z]+|\.)|[A-Z]\. ?(?:[A-Z]\. ?)?[A-Z][a-z]+|[A-Z][a-z]+(?: [A-Z]\.)?(?: [A-Z][a-z]+){0,2}")
_NAME_CJK = re.compile(rf"[{_HAN}{_KATA}{_HIRA}]{{1,8}}(?:[ 　・][{_HAN}{_KATA}{_HIRA}]{{1,6}})?")
_RUN_BACK = re.compile(rf"[{_HAN}{_KATA}{_HIRA}]{{1,14}}(?:[ 　・][{_HAN}{_KATA}{_HIRA}]{{1,6}})?$")
_RUN_BACK_LATIN = re.compile(r"(?:[A-Z][a-z]+, [A-Z](?:[a-z]+|\.)|[A-Z]\. ?(?:[A-Z]\. ?)?[A-Z][a-z]+|[A-Z][a-z]+(?: [A-Z]\.)?(?: [A-Z][a-z]+){0,2}|[A-Z]+ [A-Z]+)$")
_FIELD = re.compile(r"[ 　]?(?:連絡先|電話|住所|メール|电话|手机|邮箱|地址|tel|phone|mail).*$", re.I | re.S)
_SUBJECT = re.compile(rf"(?<=が)[^\n\0。、,が]{{0,6}}?(?:来|訪|寄っ|寄り|電話|連絡|言っ|言い|話し|答え|申し|書い|送っ|頼ん|帰っ|戻っ|出席|欠席|参加|入社|退社|担当|住ん|引っ越)")
_VERB_ZH = re.compile(r"(?:(?<=[\0\n。！？!?，,；;：: ])|(?<=昨天)|(?<=今天)|(?<=前天)|(?<=明天)|(?<=上周)|(?<=刚才))([%s]{2,4})(?=(?:到|来|去|在|从)[^\n\0。，,]{0,5}(?:来|去|住|工作|上班|购物|开会|取|买)|说(?!明)|告诉|打电话|打来|回复|写道)" % _HAN)
_REACHED = re.compile(r"[^\n\0。\d]{0,5}[+(]?\d[\d()\-. ]{8}", re.A)
_HIRA_ONLY = re.compile(rf"[{_HIRA}]+")


class Lexicon:
    """Names by script, and the automaton of all anchors."""

    def __init__(self, rows: list[tuple[str | None, str | None]]):
        import ahocorasick

        of = lambda kind: sorted({w.strip() for w, k in rows if w and w.strip() and k == kind})
        self.surnames, self.given = set(of("surname")), set(of("given"))
        self.automaton = ahocorasick.Automaton()
        words: dict[str, list] = {}

        def add(word, what):
            words.setdefault(word.lower(), []).append((what, len(word)))

        for w in ("@", "[at]", "(at)"):
            add(w, "email")
        add(" at ", "spoken")
        for w in SCHEMES:
            add(w, "scheme")
        for w in CUE_ID:
            add(w, "id")
        for w in BEFORE_NAME:
            add(w, "weak" if w in WEAK_BEFORE else "before")
        for w in HONORIFICS:
            add(w, "after")
        for w in PERSON_VERBS_EN:
            add(" " + w, "verb")
        for w in STREET_DE:
            add(w, "strasse")
        for w in self.surnames:
            add(w, "surname")
        for w in self.given:
            if len(w) > 1:
                add(w, "given")
        for w in ("省", "市", "県", "府", "町", "番地", "丁目", "号"):
            add(w, "address")
        for w in ("区", "村", "郡", "路", "街", *PREFECTURES):
            add(w, "ward")
        for w in STREET:
            add(" " + w, "street")
        for w, what in words.items():
            self.automaton.add_word(w, tuple(what))
        self.automaton.make_automaton()
        longest = lambda names: re.compile("|".join(map(re.escape, sorted(names, key=len, reverse=True))) or r"(?!)")
        self.starts = longest(self.surnames)
        self.is_given = longest(self.given)
        self.known = {w.lower() for w in self.surnames | self.given if w.isascii()} | {w.lower() for w in GIVEN_LATIN}
        self.begins = longest(self.surnames | set(SURNAMES_JA) | set(SURNAMES_ZH))


@functools.lru_cache(4)
def _lexicon(rows: tuple) -> Lexicon:
    return Lexicon(list(rows))


def _unify(points: np.ndarray) -> np.ndarray:
    """Width variants of ASCII as ASCII and capitals as small letters, one to one."""
    out = points.copy()
    wide = (out >= 0xFF01) & (out <= 0xFF5E)
    out[wide] -= 0xFEE0
    out[out == 0x3000] = 0x20
    for dash in (0x2010, 0x2011, 0x2012, 0x2013, 0x2212):
        out[out == dash] = 0x2D
    capital = (out >= 0x41) & (out <= 0x5A)
    out[capital] += 0x20
    return out


def _edge(text: str, at: int) -> str:
    return text[at] if 0 <= at < len(text) else "\0"


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def _numbers(norm: str, points: np.ndarray, offer) -> None:
    """Phones and identity numbers, from chains of digits with single separators."""
    digit = (points >= 0x30) & (points <= 0x39)
    start = np.flatnonzero(digit & ~np.r_[False, digit[:-1]])
    stop = np.flatnonzero(digit & ~np.r_[digit[1:], False]) + 1
    if not len(start):
        return
    gap = start[1:] - stop[:-1]
    between = points[np.minimum(stop[:-1], len(points) - 1)]
    second = points[np.minimum(stop[:-1] + 1, len(points) - 1)]
    # An area code in brackets belongs to what follows; any other bracket ends the number.
    area = (points[np.maximum(start[:-1] - 1, 0)] == 0x28) & (stop[:-1] - start[:-1] <= 4) & (between == 0x29)
    joined = (gap == 1) & np.isin(between, np.array([0x20, 0x2D, 0x2E], points.dtype)) | area & ((gap == 1) | (gap == 2) & np.isin(second, np.array([0x20, 0x2D], points.dtype)))
    first = np.r_[True, ~joined]
    group = np.cumsum(first) - 1
    total = np.bincount(group, stop - start)
    heads, tails = start[first], stop[np.r_[first[1:], True]]
    for k in np.flatnonzero(total >= 9):
        a, z = int(heads[k]), int(tails[k])
        while a and norm[a - 1] in "+(":
            a -= 1
        before, after = _edge(norm, a - 1), _edge(norm, z)
        chain = norm[a:z]
        cue = norm[max(0, a - 16) : a]
        cued = next((c for c in CUE_ID if c in cue), None)
        if after == "x" and not _edge(norm, z + 1).isalnum():
            chain, z, after = chain + "x", z + 1, _edge(norm, z + 1)
        glued = (before.isascii() and (before.isalnum() or before in "-_#/.")) or (after.isascii() and after.isalnum()) or after in "_/"
        if glued and not cued:
            continue
        if _ID_CN.fullmatch(chain) or (cued and _ID_JP.fullmatch(chain)) or _ID_US.fullmatch(chain):
            offer("ID_NUMBER", a, z)
        elif cued and cue.rstrip(" :#.号码是为の").endswith(cued) and _ID_CUED.fullmatch(chain):
            offer("ID_NUMBER", a, z)
        elif _PHONE.fullmatch(chain):
            offer("PHONE", a, z)
        elif (chain[0] == "(" and chain.count(")") == 0) and _PHONE.fullmatch(chain[1:]):
            offer("PHONE", a + 1, z)
        else:
            # A count or house number stands beside the number: what is left without it.
            for part in (re.sub(r"^\d{1,3} ", "", chain), re.sub(r" \d{1,3}$", "", chain)):
                at = a + chain.index(part)
                if part != chain and _PHONE.fullmatch(part):
                    offer("PHONE", at, at + len(part))
                    break
                if part != chain and (_ID_CN.fullmatch(part) or cued and _ID_JP.fullmatch(part)):
                    offer("ID_NUMBER", at, at + len(part))
                    break


def _email(norm: str, lo: int, at: int, hi: int, offer) -> None:
    left = _EMAIL_LEFT.search(norm[max(lo, at - 66) : at])
    right = _EMAIL_RIGHT.match(norm, at, min(hi, at + 120)) if norm[at] in "@[(" else None
    if not left or not right:
        return
    spaced = left.group()[-1].isspace()
    if spaced and norm[at] == "@":  # "look @name" is no address
        return
    offer("EMAIL", at - len(left.group()), right.end())


def _address(orig: str, norm: str, lo: int, at: int, end: int, hi: int, offer, names: set | None = None) -> None:
    """From an address unit: the longest Chinese or Japanese address around it that ends in a house number.

    With ``names``, what stands before the number must be more than a family name or a word such as 地区.
    """
    begin = max(lo, at - 24)
    for pattern, chinese in ((_ADDRESS_ZH, True), (_ADDRESS_JA, False)):
        for m in pattern.finditer(norm, begin, min(hi, end + 64)):
            if not m.start() <= at < m.end():
                continue
            head = _edge(norm, m.start() - 1) if m.start() > lo else "\0"
            whole = m.group()
            if m.start() == begin > lo:
                continue
            han = re.match(rf"[{_HAN}]", head) is not None
            units = len(re.findall("[省市区县]" if chinese else "[県府都道市区町村郡]", whole[: re.search(r"\d", whole).start()]))
            if not units or head.isdigit() or (han and not (chinese and head in _ZH_STOP)):
                continue
            place = whole[: re.search(r"\d", whole).start()]
            if names is not None and not chinese and (place in names or place.endswith(NOT_PLACE)):
                continue
            offer("ADDRESS", m.start(), m.end())
            return


def _street(orig: str, norm: str, lo: int, at: int, end: int, hi: int, offer) -> None:
    if _edge(norm, end).isalnum():
        return
    left = _ADDRESS_EN.search(norm[max(lo, at - 56) : at + 1])
    if left and orig[at + 1].isupper():
        start = at + 1 - len(left.group())
        if not _edge(norm, start - 1).isalnum():
            tail = _ADDRESS_EN_TAIL.match(orig, end, hi)
            offer("ADDRESS", start, tail.end())


def _spoken(norm: str, lo: int, at: int, hi: int, offer) -> None:
    """An address that is spelled out: ``jane at example dot com``."""
    left, right = _SPOKEN_LEFT.search(norm[max(lo, at - 66) : at]), _SPOKEN_RIGHT.match(norm, at, min(hi, at + 120))
    if left and right:
        offer("EMAIL", at - len(left.group()), right.end())


def _identity(norm: str, end: int, hi: int, offer) -> None:
    """A number with letters that an identifier cue announces."""
    at = _CUE_GAP.match(norm, end, min(hi, end + 16)).end()
    m = _ID_LETTERS.match(norm, at, hi)
    if m and at > end and sum(c.isdigit() for c in m.group()) >= 6:
        offer("ID_NUMBER", at, m.end())


def _accounts(norm: str, offer) -> None:
    """International account numbers: the remainder by 97 is 1."""
    for m in _IBAN.finditer(norm):
        whole = m.group().replace(" ", "")
        if len(whole) >= 15 and int("".join(str(int(c, 36)) for c in whole[4:] + whole[:4])) % 97 == 1:
            offer("ID_NUMBER", m.start(), m.end())


def _strasse(orig: str, lo: int, at: int, end: int, hi: int, offer) -> None:
    left = _STRASSE_LEFT.search(orig[max(lo, at - 40) : at])
    right = _STRASSE_RIGHT.match(orig, end, hi)
    if left and left.group() and right and left.group()[0].isupper() and len(left.group()) > 2:
        offer("ADDRESS", at - len(left.group()), right.end())


def _subjects(orig: str, norm: str, lex: Lexicon, offer) -> None:
    """Names before a verb of persons, known by a part or by their shape."""
    for m in _SUBJECT.finditer(norm):
        at = m.start() - 1
        run = _RUN_BACK.search(orig[max(0, at - 24) : at])
        if not run:
            _name_before(orig, norm, max(0, orig.rfind("\0", 0, at) + 1), at, lex, False, offer)
            continue
        name, changed = run.group(), True
        while changed:
            changed = False
            for lead in LEAD_IN:
                if name.startswith(lead) and len(name) > len(lead):
                    name, changed = name[len(lead) :], True
        before = _edge(orig, at - len(name) - 1)
        led = len(name) < len(run.group()) or not (before.isalnum() or before in "のはをにと")
        spaced = re.fullmatch(rf"[{_HAN}]{{1,4}}[ 　][{_HAN}{_HIRA}]{{1,4}}|[{_KATA}]{{2,}}[ 　・][{_KATA}]{{2,}}", name)
        timed = len(name) < len(run.group()) and re.fullmatch(rf"[{_HAN}]{{4,7}}", name)  # after a word of time, as long as two names
        if not timed and len(name) < len(run.group()) and re.fullmatch(rf"[{_HAN}]{{2,3}}", name):
            timed = _REACHED.match(norm, m.end(), m.end() + 12)  # with a phone number or address of mail close behind
        if led and name not in COMMON_PERSONS and (spaced or timed or re.fullmatch(rf"[{_HAN}]{{2,4}}[{_HAN}{_HIRA}]{{0,3}}", name) and lex.begins.match(name)):
            offer("NAME", at - len(name), at)
        elif led and _plausible(name, lex) and len(name) <= 10 and not re.search("[はをにがで]", name):
            offer("NAME", at - len(name), at)
    for m in _VERB_ZH.finditer(norm):
        name = m.group(1)
        for lead in LEAD_IN:
            name = name[len(lead) :] if name.startswith(lead) else name
        known = lex.begins.match(name) or any(name.endswith(g) for g in lex.given if len(g) > 1)
        timed = norm.startswith(("昨天", "今天", "前天", "明天", "上周", "刚才"), m.end(1) - len(name) - 2) and len(name) == 3
        if 2 <= len(name) <= 4 and not any(w in name for w in COMMON_PERSONS if len(w) > 1) and (known or timed):
            offer("NAME", m.end(1) - len(name), m.end(1))


def _plausible(name: str, lex: Lexicon) -> bool:
    """Whether a run of letters can be a name on its own evidence: a known part, or two parts in one script."""
    if lex.starts.match(name) or name in lex.given or name in SURNAMES_JA:
        return True
    common = next((w for w in SURNAMES_JA if name.startswith(w)), None)
    if common and len(name) - len(common) <= 3:
        return True
    tail = next((g for g in lex.given if name.endswith(g) and len(g) > 1), None)
    return tail is not None or re.fullmatch(rf"[{_KATA}]{{2,}}[ 　・][{_KATA}]{{2,}}", name) is not None


def _not_a_name(orig: str, norm: str, start: int, end: int) -> bool:
    after = norm[end : end + 12]
    if after.startswith(NOT_AFTER_SURNAME) and not after.startswith("记者"):
        return True
    word = after[1:] if after[:1] == " " else after
    if word.startswith(NOT_AFTER_LATIN) and orig[start].isascii():
        return True
    b, a = _edge(norm, start - 1), _edge(norm, end)
    if orig[start].isascii() and (b.isascii() and (b.isalnum() or b in "@._+-") or a.isascii() and (a.isalnum() or a in "@_+") or (a in ".-" and _edge(norm, end + 1).isalnum())):
        return True
    return a == "@"


def _looks_latin(name: str, lex: Lexicon) -> bool:
    """Whether capitalised words are a name on their own evidence: a known part, an initial, or two and more of them."""
    words = re.findall(r"[A-Za-z]+", name)
    return any(w.lower() in lex.known for w in words) or len(words) >= 2 and not any(w in NOT_NAMES for w in words)


def _name_after(orig: str, norm: str, lo: int, at: int, hi: int, lex: Lexicon, offer, weak: bool = False) -> None:
    """A name that a cue announces; one announced weakly must look like a name."""
    while at < hi and orig[at] in " 　:：":
        at += 1
    title = re.compile(r"(?:mr|mrs|ms|miss|dr|prof)\.? ").match(norm, at, hi)
    if title:
        at = title.end()
    m = _NAME_LATIN.match(orig, at, min(hi, at + 48))
    if not m:
        m = _NAME_CJK.match(orig, at, min(hi, at + 18))
        if not m:
            return
        name = _FIELD.sub("", m.group())
        for cut in ("さん", "様", "先生", "老师", "女士", "小姐", "が店", "です", "到店"):
            i = name.find(cut, 1)
            if i > 0:
                name = name[:i]
        parts = re.split(r"[ 　・]", name)
        if len(parts) == 2 and not _plausible(name, lex) and re.fullmatch(rf"[{_HIRA}]+", parts[1]) is None and len(parts[1]) > 4:
            name = parts[0]
        if weak:
            # Family name and one or two more, up to where the words go on.
            m = lex.begins.match(name)
            if not m:
                return
            rest = re.match(rf"[ 　]?(?:(?![はがをにでとのも是在和的了])[{_HAN}{_HIRA}]){{1,{2 if len(m.group()) == 1 else 3}}}", name[m.end() :])
            name = m.group() + (rest.group() if rest else "")
            if not rest and len(name) < 2:
                return
        if not name or _HIRA_ONLY.fullmatch(name) or len(name.replace(" ", "")) > 10:
            return
        end = at + len(name)
    else:
        end = m.end()
        if weak and not _looks_latin(m.group(), lex):
            return
    if not _not_a_name(orig, norm, at, end):
        offer("NAME", at, end)


def _name_before(orig: str, norm: str, lo: int, at: int, lex: Lexicon, strong: bool, offer) -> None:
    """A name that a title or phrase follows."""
    window = orig[max(lo, at - 30) : at]
    m = _RUN_BACK_LATIN.search(window)
    if m and m.group():
        start = at - len(m.group())
        name = m.group()
        first = re.match(r"(?:Mr|Mrs|Ms|Dr|Prof)\b\.? ?", name)
        if first:
            start += first.end()
        elif not strong and not _looks_latin(name, lex):
            return
        if start < at and not _not_a_name(orig, norm, start, at) or (start < at and norm[at : at + 1] in " さ様先が"):
            if not re.match(r"[A-Za-z0-9@._+\-]", _edge(orig, start - 1)):
                offer("NAME", start, at)
        return
    m = _RUN_BACK.search(window)
    if not m:
        return
    name = m.group()
    if norm[at] == "收" and (_edge(norm, at - len(name) - 1) not in ",、:" or not 2 <= len(name) <= 4):
        return
    changed = True
    while changed:
        changed = False
        for lead in LEAD_IN:
            if name.startswith(lead) and len(name) > len(lead):
                name, changed = name[len(lead) :], True
    if not _plausible(name, lex):
        inner = [i for i in range(1, len(name)) if lex.starts.match(name, i) and (len(lex.starts.match(name, i).group()) > 1 or any(name.endswith(g) for g in lex.given))]
        if inner and len(name) - inner[0] <= 9 and name[inner[0] - 1] in "のはをにがと、" + _ZH_STOP:
            name = name[inner[0] :]
        elif not strong or len(name) > 8 or name[0] in "おご" or re.search(r"[はをにがで]", name) or re.match(rf"[{_HIRA}]", name):
            return
    if len(name) < 2 and name not in lex.surnames:
        return
    offer("NAME", at - len(name), at)


def find(texts: list[str | None], lex: Lexicon) -> list[list[tuple[str, int, int]]]:
    """Of each text the findings ``(type, start, end)`` in order; findings never overlap."""
    joined = "\0".join(t or "" for t in texts)
    original = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = _unify(original)
    norm = points.tobytes().decode("utf-32-le", "surrogatepass")
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t or "") + 1 for t in texts], out=bounds[1:])
    offers: list[tuple[int, int, int, str]] = []
    rank = {t: i for i, t in enumerate(("EMAIL", "ID_NUMBER", "PHONE", "ADDRESS", "NAME"))}

    def offer(kind, start, end):
        offers.append((rank[kind], start, end, kind))

    _numbers(norm, points, offer)
    _accounts(norm, offer)
    _subjects(joined, norm, lex, offer)
    hits = list(lex.automaton.iter(norm))
    doc = (np.searchsorted(bounds, np.array([e for e, _ in hits], np.int64), side="right") - 1).tolist()
    for (last, kinds), d in zip(hits, doc, strict=True):
        lo, hi = int(bounds[d]), int(bounds[d + 1]) - 1
        end = last + 1
        for what, size in kinds:
            at = end - size
            if what == "email":
                _email(norm, lo, at, hi, offer)
            elif what == "address":
                if any(c.isdigit() for c in norm[max(lo, at - 4) : min(hi, end + 40)]):
                    _address(joined, norm, lo, at, end, hi, offer)
            elif what == "ward":
                if any(c.isdigit() for c in norm[end : min(hi, end + 40)]):
                    _address(joined, norm, lo, at, end, hi, offer, lex.surnames)
            elif what == "street":
                _street(joined, norm, lo, at, end, hi, offer)
            elif what == "strasse":
                _strasse(joined, lo, at, end, hi, offer)
            elif what == "spoken":
                _spoken(norm, lo, at, hi, offer)
            elif what == "scheme":
                m = _TEL.match(norm, end, hi)
                if m and 7 <= _digits(m.group()) <= 15 and norm[at : at + 4] != "mail":
                    offer("PHONE", m.start(), m.end())
            elif what == "id":
                if not (norm[at].isascii() and _edge(norm, at - 1).isalnum()):
                    _identity(norm, end, hi, offer)
            elif what in ("before", "weak"):
                if not (norm[at].isascii() and norm[at].isalpha() and _edge(norm, at - 1).isalnum()):
                    _name_after(joined, norm, lo, end, hi, lex, offer, what == "weak")
            elif what == "verb":
                if not _edge(norm, end).isalnum():
                    _name_before(joined, norm, lo, at, lex, False, offer)
            elif what == "after":
                title = norm[at:end]
                strong = title[0] == "收" or norm.startswith(AFTER_TITLE.get(title, ("\x01",)), end)
                if title == "です":
                    run = _RUN_BACK.search(joined[max(lo, at - 14) : at])
                    if not run or run.group().endswith(NOT_AFTER_SURNAME) or not re.fullmatch(rf"[{_HAN}]{{2,4}}[{_HAN}{_HIRA}]{{0,3}}", run.group()) or not lex.begins.match(run.group()) or run.group()[:2] not in SURNAMES_JA and not lex.starts.match(run.group()):
                        continue
                _name_before(joined, norm, lo, at, lex, strong, offer)
            else:
                # A lexicon word: a family name with a given name beside it, in either order.
                if joined[at:end] not in (lex.surnames if what == "surname" else lex.given):
                    continue
                other = lex.is_given if what == "surname" else lex.starts
                gap = end
                while gap < hi and gap < end + 2 and joined[gap] in " 　・,":
                    gap += 1
                m = other.match(joined, gap, hi)
                if m and m.group() and (what == "surname" or gap > end) and not (gap == end and joined[at].isascii()) and not _not_a_name(joined, norm, at, m.end()):
                    offer("NAME", at, m.end())
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    taken = np.zeros(len(points) + 1, bool)
    offers.sort(key=lambda o: (o[0], o[1], -o[2]))
    for _, start, end, kind in offers:
        if not taken[start:end].any():
            taken[start:end] = True
            d = int(np.searchsorted(bounds, start, side="right")) - 1
            out[d].append((kind, start - int(bounds[d]), end - int(bounds[d])))
    for found in out:
        found.sort(key=lambda f: f[1])
    return out


#: Characters parsed at once; bounds the memory of a task.
CHUNK_CHARS = 1_000_000


def _chunks(texts):
    start, size = 0, 0
    for stop in range(1, len(texts) + 1):
        size += len(texts[stop - 1] or "")
        if size >= CHUNK_CHARS or stop == len(texts):
            yield start, stop
            start, size = stop, 0


def _find_batches(batches, words):
    import pyarrow as pa

    lex = _lexicon(tuple(words.value))
    for batch in batches:
        names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows = [(names[a + i], kind, s, e) for a, z in _chunks(texts) for i, found in enumerate(find(texts[a:z], lex)) for kind, s, e in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())], ["doc_id", "pii_type", "start_pos", "end_pos"])


def redact(text: str | None, found: list[tuple[str, int, int]]) -> str | None:
    if not found:
        return text
    out, at = [], 0
    for kind, start, end in found:
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]])


def _redact_batches(batches, words):
    import pyarrow as pa

    lex = _lexicon(tuple(words.value))
    for batch in batches:
        texts = batch.column(1).to_pylist()
        done = [(redact(t, f), len(f)) for a, z in _chunks(texts) for t, f in zip(texts[a:z], find(texts[a:z], lex), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())], ["doc_id", "text", "replaced"])


def _words(lexicon: DataFrame):
    rows = lexicon.where("word is not null and kind in ('surname', 'given')").select("word", "kind").distinct().limit(LEXICON_ROWS + 1).collect()
    if len(rows) > LEXICON_ROWS:
        raise ValueError(f"the lexicon has more than {LEXICON_ROWS} names")
    return lexicon.sparkSession.sparkContext.broadcast(sorted((r[0], r[1]) for r in rows))


def find_personal(documents: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(doc_id, pii_type, start_pos, end_pos)``: one row per occurrence; offsets in code points, ``end_pos`` exclusive."""
    words = _words(lexicon)
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null").mapInArrow(lambda b: _find_batches(b, words), "doc_id bigint, pii_type string, start_pos bigint, end_pos bigint").distinct()


def redact_personal(documents: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(doc_id, text, replaced)``: each row of the documents with placeholders such as ``[EMAIL]`` for what was found."""
    words = _words(lexicon)
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(lambda b: _redact_batches(b, words), "doc_id bigint, text string, replaced int")
