"""Personal information inside free text: anchor expansion.

An Aho-Corasick automaton over the folded lower-case text finds anchors: at-signs in any spelling, cues for telephone and
identity numbers, street words, and family names of the gazetteer; runs of digits are anchors of their own. Local parsers grow an
anchor to the left and right and validate what they get: domains need a top level, numbers a length, a national form or a
cue nearby, streets a house number, family names a given name or initial. Spans that overlap are settled in the order
e-mail, identity number, phone, address, name. Offsets are code points of the stored text.

The gazetteer is learned from the corpus: where titles, cues and hints announce a name, capitalised words of the shape of
one are counted over all texts, and those that stand with several different partners join a short list of common names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: most names that learn_names() brings to the driver
MAX_NAMES = 500_000
TYPES = ("email", "id_number", "phone", "address", "name")


class Span(NamedTuple):
    """One personal datum, [start, end)."""

    kind: str
    start: int
    end: int


# Common names, the least gazetteer; learn_names() adds those of the corpus. Family names with their particles
GIVEN = (
    "james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth barbara susan jessica sarah karen emma olivia "
    "peter hans klaus jürgen wolfgang stefan andreas monika sabine petra ursula anna jean pierre michel philippe nicolas marie nathalie isabelle sophie camille "
    "josé juan antonio manuel francisco carlos carmen maría isabel lucía joão pedro paulo luís ana teresa marco giuseppe giovanni luca matteo giulia francesca chiara "
    "jan pieter kees willem anneke marieke sanne daan lotte"
).split()
FAMILY = (
    "smith|jones|taylor|brown|williams|wilson|johnson|davies|miller|moore|anderson|thompson|müller|schmidt|schneider|fischer|weber|meyer|wagner|becker|hoffmann|"
    "martin|bernard|dubois|durand|leroy|moreau|laurent|garcía|fernández|gonzález|rodríguez|lópez|martínez|sánchez|pérez|silva|santos|ferreira|pereira|oliveira|costa|"
    "rossi|russo|ferrari|esposito|bianchi|romano|colombo|de jong|jansen|de vries|van den berg|bakker|visser|van dijk"
).split("|")
FAMILY_ZH = (
    "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳"
    "酆鲍史唐费廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐于时傅皮卞齐康伍余元卜顾孟平黄和穆萧尹姚邵湛汪祁毛禹狄米贝明臧计伏成戴谈宋茅庞"
    "熊纪舒屈项祝董梁杜阮蓝闵席季麻强贾路娄危江童颜郭梅盛林刁钟徐邱骆高夏蔡田樊胡凌霍虞万支柯管卢莫经房裘缪干解应宗丁宣邓"
    "郗宓扈"
)
GIVEN_ZH = "伟|芳|娜|秀英|敏|静|丽|强|磊|军|洋|勇|艳|杰|建国|志强|国强|海燕|小红|建华".split("|")

AT = ("@", "[at]", "(at)", "{at}", " at ", " arroba ", " arobase ", " chiocciola ", " apenstaartje ", " klammeraffe ", "艾特", "[arroba]", "(arroba)")
DOT = r"(?:\.|\s\.\s|\s?[\[({](?:dot|\.|punto|point|punkt|ponto|punt)[\])}]\s?|\s(?:dot|punto|point|punkt|ponto|punt)\s|\s?点\s?)"
_SEP = r"(?:\s(?:dot|punto|point|punkt|ponto|punt|plus|più|mais|más|underscore|unterstrich|guion bajo|tiret bas|trattino basso|liggend streepje|minus|dash)\s)"
_ATOM = r"[a-z0-9][a-z0-9._%+'\-]*"
_LOCAL = re.compile(r"[a-z0-9_][a-z0-9._%+\-]*$")
_SPOKEN_LOCAL = re.compile(rf"(?<![a-z0-9@._\-]){_ATOM}(?:{_SEP}{_ATOM})*$")
_DOMAIN = re.compile(rf"[a-z0-9][a-z0-9\-]*(?:{DOT}[a-z0-9\-]+)*?{DOT}[a-z]{{2,}}(?![a-z0-9@\-])(?:{DOT}(?:[a-z]{{2,}})(?![a-z0-9@\-]))*")
_PLAIN_DOMAIN = re.compile(r"[a-z0-9][a-z0-9\-]*(?:\.[a-z0-9\-]+)*\.[a-z]{2,}(?![a-z0-9@\-])")

_GOES_ON = re.compile(r"\s?(?:@|[\[(]at[\])]|at\s|arroba\s|arobase\s|chiocciola\s|apenstaartje\s|plus\s|underscore\s)")

PHONE_CUES = (
    "tel", "tél", "fax", "phone", "call ", "number is", "voicemail", "mobile", "numéro est", "téléphon", "nummer ist", "telefon", "ruf ",
    "número es", "teléfono", "llame", "nummer is", "telefoon", "número é", "ligue", "numero è", "telefono", "cellulare", "portable", "handy",
    "móvil", "telemóvel", "电话", "手机", "拨打", "传真", "致电",
)
#: cues that are whole words
WHOLE_CUES = frozenset(("tel", "tél", "fax", "phone", "dni", "nif", "bsn", "ligue", "llame", "card"))
ID_CUES = (
    "identity", "identity card", "id card", "id number", "card", "passport", "insurance no", "social security", "national insurance",
    "tax ", "ausweis", "ausgestellt auf", "steuer", "personalnummer", "sozialversicherung", "pièce d'identité", "sécurité sociale",
    "carte d'identité", "dni", "documento de identidad", "documento de identidade", "documento d'identità", "codice fiscale", "carta d'identità",
    "cartão de cidadão", "contribuinte", "nif", "identiteitsbewijs", "bsn", "burgerservice", "paspoort", "pasaporte", "passaporto", "passeport",
    "reisepass", "身份证", "证件", "护照", "社保", "identidad", "identificación", "identificação", "numéro fiscal",
)
STREET_EN = "street|st|road|rd|row|lane|ln|avenue|ave|hill|court|ct|drive|square|terrace|close|way|place|crescent|gardens|mews|walk"
_NUM_EN = r"(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety)"
_NUM_FR = r"(?:un|deux|trois|quatre|cinq|six|sept|huit|neuf|dix|onze|douze|treize|quatorze|quinze|seize|vingts?|trente|quarante|cinquante|soixante|cents?|et)"
_NUM_LATE = (
    r"(?:(?:ein|zwei|drei|vier|fünf|sechs|sieben|acht|neun|zehn|elf|zwölf|\w*hundert\w*|\w*zehn|\w*zig|\w*honderd\w*|\w*tien|\w*tig|een|twee|drie|vijf|zes|zeven|negen|"
    r"uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|diez|once|doce|trece|catorce|quince|dieci\w*|veint\w+|treinta|cuarenta|cincuenta|sesenta|setenta|ochenta|noventa|cien|ciento|doscientos|"
    r"due|tre|quattro|cinque|sei|sette|otto|nove|undici|dodici|\w+dici|vent\w+|trent\w+|quarant\w+|cinquant\w+|sessant\w+|settant\w+|ottant\w+|novant\w+|cento\w*|"
    r"um|dois|três|quatro|sete|oito|dez|doze|treze|quinze|dezas\w+|vinte|trinta|quarenta|cinquenta|sessenta|oitenta|cem|duzentos)\b)"
)
_HOUSE = r"\d{1,4}\s?(?:[a-h]\b)?(?:\s?[-–/]\s?\d{1,4}[a-h]?)?"
_WORD = r"[^\W\d_](?:[^\W\d_]|['’\-])*"
_SKIP = (
    r"(?!(?:of|the|and|in|on|at|to|a|an|for|from|with|by|was|were|is|seconds|folder|noted|dated|revision|page|entry|lot|reel|take|bit|frames|boxes|"
    r"january|february|march|april|may|june|july|august|september|october|november|december)\b)"
)
ADDRESS = (
    re.compile(rf"(?<![\w/.\-])(?:\d{{1,4}}[a-z]?(?:\s?[-–/]\s?\d{{1,4}}[a-z]?)?|(?:{_NUM_EN}|a hundred|one hundred)(?:[ \-](?:{_NUM_EN}|hundred|and))*)[,]?\s+(?:{_SKIP}{_WORD}\s+){{1,3}}(?:{STREET_EN})\b\.?"),
    re.compile(rf"(?<![\w/.\-])(?:\d{{1,4}}(?:\s?(?:bis|ter|quater)\b)?|{_NUM_FR}(?:[ \-]{_NUM_FR})*)\s?,?\s+(?:rue|avenue|boulevard|bd|impasse|place|quai|chemin|allée|route|cours|passage|villa)\s+{_WORD}(?:\s{_WORD}){{0,3}}"),
    re.compile(rf"(?<![\w\-])(?:(?:am|an der|im|zum|zur|alte|alter|neue|neuer|große|kleine|kleiner|auf dem|auf der|unter den|oude|nieuwe|grote|korte|lange)\s+)*[^\W\d_][\w\-]{{2,}}(?:straße|strasse|str\.|weg|gasse|allee|platz|ufer|wehr|damm|steig|graben|straat|laan|gracht|plein|kade|dijk|steeg|singel)\s+(?:{_HOUSE}|{_NUM_LATE})(?!\d|[.:/\-]\d)"),
    re.compile(rf"(?<![\w\-])(?:calle|c/|avda\.?|avenida|plaza|paseo|camino|ronda|travesía|via|viale|piazza|piazzale|corso|vicolo|largo|rua|av\.|travessa|praça|alameda|estrada|beco)\s+{_WORD}(?:\s{_WORD}){{0,4}},?\s+(?:n\.?\s?[ºo°]\.?\s*)?(?:{_HOUSE}|{_NUM_LATE})(?!\d|[.:/\-]\d)"),
    re.compile(r"(?:(?![到在址于往向住给从了是寄送去回的地])[一-鿿]){2,4}?(?:省|市|县|州)(?:(?:(?![路街巷弄道])[一-鿿]){1,4}?(?:市|区|县|镇|乡))?[一-鿿]{1,5}?(?:路|街|巷|弄|大道|胡同)\s?[0-9一二三四五六七八九十百零〇]{1,6}\s?号(?:\s?[0-9一二三四五六七八九十百]+\s?(?:单元|栋|楼|室|号))*"),
)
#: words that a street of each of the forms above holds
STREET_ANCHORS = (
    tuple(STREET_EN.split("|")),
    ("rue ", "avenue ", "boulevard ", "bd ", "impasse ", "place ", "quai ", "chemin ", "allée ", "route ", "cours ", "passage ", "villa "),
    ("straße ", "strasse ", "str. ", "weg ", "gasse ", "allee ", "platz ", "ufer ", "wehr ", "damm ", "steig ", "graben ", "straat ", "laan ", "gracht ", "plein ", "kade ", "dijk ", "steeg ", "singel "),
    (
        "calle ", "c/ ", "avda", "avenida ", "plaza ", "paseo ", "camino ", "ronda ", "travesía ", "via ", "viale ", "piazza ", "piazzale ", "corso ", "vicolo ", "largo ", "rua ", "av. ", "travessa ",
        "praça ", "alameda ", "estrada ", "beco ",
    ),
    ("号",),
)
ADDRESS_CUE = re.compile(r"(?:lives? at|moved to|moved out of|went to|tenant of|address:?|deliver(?:ed)? to|sent to|living at|resid\w+ at|parti pour|habite|demeure)\s*$")

#: no Latin letter or digit in front; Chinese runs straight into numbers
_FREE = r"(?<![0-9a-zà-ɏ@_])"
_NUMBER = re.compile(_FREE + r"[+(]{0,2}\d(?:[ .\-/()]{0,3}\d)+(?![\d])")
#: two digits, which every form of an identity number holds, also one with letters in front
_PAIR = re.compile(r"\d\d")
#: digits with few characters between them; letters that an identity number may have in front
_CLUSTER = re.compile(r"\d+(?:[ .\-/()a-z]{0,3}\d+)*")
LETTERS_FIRST = 10
_DATE = re.compile(r"(?:(?:19|20)\d\d[-./](?:0?[1-9]|1[0-2])[-./](?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-./](?:0?[1-9]|1[0-2])[-./](?:19|20)\d\d)$")
#: shelf marks and the like: two numbers with a stroke between
_MARK = re.compile(r"[(]?[1-9]\d{1,5}/\d{1,3}[)]?$")
#: national and international forms that need no cue
PHONE_FORMS = (
    r"\+\d{1,3}[ .\-/]{0,2}(?:\(0\)[ .\-/]{0,2})?(?:\(\d{1,4}\)[ .\-/]{0,2})?\d(?:[ .\-/]{0,3}\d){5,12}",
    r"00[1-9]\d[ .\-/]{1,2}\(?\d(?:[ .\-/)]{0,3}\d){6,11}",
    r"\(\d{2,5}\)[ .\-/]{0,3}\d{2,8}(?:[ .\-/]\d{2,6}){0,3}",
    r"[2-9]\d{2}([ .\-])\d{3}\1\d{4}",
    r"1?[2-9]\d{2}555\d{4}",
    r"0\d{2,4}[ .\-/]{1,3}\d{2,5}(?:[ .\-/]\d{2,5}){0,3}",
    r"0\d([ .\-])\d{2}(?:\2\d{2}){3}",
    r"1[3-9]\d([ \-]?)\d{4}\3\d{4}",
    r"[36789]\d{2}([ .\-])\d{3}\4\d{3}",
)
_PHONE = re.compile("|".join(f"(?:{p})" for p in PHONE_FORMS))
#: forms of identity numbers that need no cue
ID_FORMS = (
    _FREE + r"[a-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[a-d](?![a-z0-9])",
    _FREE + r"(?<![/.\-])\d{3}([- ])\d{2}\1\d{4}(?![0-9a-zà-ɏ/\-]|\.\d)",
    _FREE + r"(?<![/.\-])\d{6} ?(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01]) ?\d{3}[\dx](?![0-9a-zà-ɏ/])",
    _FREE + r"(?<![/.\-])[12] ?\d{2} ?(?:0[1-9]|1[0-2]) ?\d{2} ?\d{3} ?\d{3} ?\d{2}(?![0-9a-zà-ɏ/])",
    _FREE + r"(?<![/.\-])\d{2}\.?\d{3}\.?\d{3}-?[a-hj-np-tv-z](?![0-9a-zà-ɏ/])",
)
ID_FORMS += (_FREE + r"[a-z]{6}\d{2}[a-z]\d{2}[a-z]\d{3}[a-z](?![0-9a-zà-ɏ])",)
#: characters within which a cue before a number, or behind it, counts for it; in which a spoken local part lies
CUE_WINDOW, CUE_BEHIND, LOCAL_WINDOW = 45, 10, 160
_CLAUSE_END = re.compile(r"[.!?;](?:\s|$)|[。！？；\d\n]")
_ID = re.compile("|".join(f"(?:{p})" for p in ID_FORMS))
#: letters and digits mixed, as in passports and cards; only with a cue
_LETTERED_ID = re.compile(_FREE + r"(?<![/.\-])(?:[a-z]{1,2}\d{6,9}[a-z]?|[a-z][a-z0-9]{7,9})(?![0-9a-zà-ɏ/\-])")
DIGIT_WORDS = (
    "zero|oh|one|two|three|four|five|six|seven|eight|nine|double|triple",
    "zéro|un|deux|trois|quatre|cinq|six|sept|huit|neuf",
    "null|eins|zwei|zwo|drei|vier|fünf|sechs|sieben|acht|neun",
    "cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve",
    "zero|um|dois|três|quatro|cinco|seis|sete|oito|nove",
    "zero|uno|due|tre|quattro|cinque|sei|sette|otto|nove",
    "nul|een|één|twee|drie|vier|vijf|zes|zeven|acht|negen",
)
DIGITS_ZH = "零一二三四五六七八九幺〇"
#: digit words in a row that make a number
SPOKEN_LEAST = 7
_SPOKEN = (*[re.compile(rf"\b(?:(?:{w})(?:[ ,\-]+|\b)){{{SPOKEN_LEAST},}}") for w in DIGIT_WORDS], re.compile(rf"[{DIGITS_ZH}]{{{SPOKEN_LEAST},}}"))

_TITLE = r"(?:(?:dr|prof|mr|mrs|ms|mme|mlle|herr|frau|hr|fr|sr|sra|sig|dra|dott|ing)\.?\s+)*"
_CAP = r"[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+(?:[-'’][A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+)*"
#: a family name may also begin with one letter and an apostrophe
_FAM = rf"(?:[A-Z]['’])?{_CAP}"
#: words that announce a name so surely that its shape decides
NAME_CUES = (
    "signed by", "regards,", "sincerely,", "according to", "spoke with", "ask for", "attention", "attn", "interviewer:", "my name is", "cordialement,", "je m'appelle",
    "mit freundlichen grüßen,", "ich heiße", "firmado:", "un saludo,", "atentamente,", "me llamo", "cumprimentos,", "chamo-me", "cordiali saluti,", "mi chiamo",
    "met vriendelijke groet,", "mijn naam is", "sprachen mit", "parlé avec", "hablamos con", "parlato con", "falámos com", "spraken met",
)
#: words that often stand before a name; what follows counts for learn_names() only
HINTS = (
    "said", "reach", "contact", "present:", "witness", "and", "dear", "sagte", "laut", "erreichen", "disait", "dit", "selon", "joindre", "decía", "dijo", "según", "escribir a", "disse", "segundo",
    "escrever a", "diceva", "secondo", "scrivere a", "zei", "volgens", "bereiken",
)
_ANNOUNCED = re.compile(
    rf"(?:{'|'.join(re.escape(c) for c in NAME_CUES)})\s+(?i:{_TITLE})({_CAP}(?:\s[A-Z]\.)?\s(?:(?:de|van|von|da|di|la|del|du|der)\s)*{_CAP}|{_CAP},\s{_CAP})(?![\w-])",
)
#: titles before a name, each an anchor of its own; capitalised, with two capitalised words or an initial and one behind
TITLES = ("mr", "mrs", "ms", "dr", "prof", "professor", "herr", "frau", "mme", "mlle", "madame", "monsieur", "sig", "signor", "signora", "señor", "señora", "sra", "dott", "mevrouw", "meneer", "senhor", "senhora")
_PARTICLE = r"(?:(?:de|van|von|da|di|la|del|der|du|den|dos|ter)\s){0,2}"
_TITLED = re.compile(
    rf"(?<![\w@.\-])(?:(?i:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.?\s+)+({_CAP}(?:\s[A-Z]\.){{0,2}}\s{_PARTICLE}{_CAP}|(?:[A-Z]\.\s?){{1,3}}{_PARTICLE}{_CAP})(?![\w-])"
)
_THINGS = (*STREET_EN.split("|"), "trust", "archive", "library", "museum", "school", "hospital", "foundation", "prize", "hall", "bridge", "college", "society")
#: after the name of a street, a house and the like a titled name is none
_NO_PERSON = re.compile(rf"[^.!?\n]?\s(?:{'|'.join(_THINGS)})\b", re.IGNORECASE)
#: the same, capitalised, after names of the gazetteer, which are found in any letter case
_THING = re.compile(rf"\s(?:{'|'.join(w.capitalize() for w in _THINGS)})\b")
_HAN = re.compile("[一-鿿]")
#: characters behind a cue in which the name it announces ends
NAME_WINDOW = 160
_ZH_ANNOUNCED = re.compile(rf"(?:联系|据|此致[，,]?|收件人|签名[：:]?|署名[：:]?|采访者[：:]?|在场[：:]?|姓名[：:]?|我们和|签字人[：:]?)([{FAMILY_ZH}][一-鿿]{{1,2}})(?=[，,。、；说住签谈：]|邮箱|地址|$)")

#: a name by its shape: given and family name, family name and given name, initials and family name
_SHAPE = re.compile(
    rf"(?:(?P<given>{_CAP})(?:\s[A-Z]\.){{0,2}}\s(?P<family>{_PARTICLE}{_FAM})|(?P<family_b>{_PARTICLE}{_FAM}),\s(?P<given_b>{_CAP})|(?:[A-ZÀ-Þ]\.\s?){{1,2}}(?P<family_c>{_PARTICLE}{_FAM}))(?![\w-])"
)
_THEN = re.compile(rf"\.?\s+(?:(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.?\s+)*")
_SEED_ZH = re.compile(rf"(?:联系|据|此致[，,]?|收件人|签名[：:]?|署名[：:]?|采访者[：:]?|在场[：:]?|姓名[：:]?|我们和|签字人[：:]?|同|找|问)([{FAMILY_ZH}])([一-鿿]{{2,3}}?)(?=[，,。、；说住签谈：的]|邮箱|地址|$)")
#: capitalised words that begin no name
NO_GIVEN = frozenset("the a an our my your his her this that der die das ein eine unser unsere le la les un une notre el los las una nuestra o a os as il lo i gli de het een ons onze".split())

_FOLD = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_FOLD |= {c: " " for c in (0xA0, 0x3000, 0x2009, 0x202F, *range(0x2000, 0x200B))}
_FOLD |= {c: "-" for c in (0x2010, 0x2011, 0x2012, 0x2212)} | {0x2019: "'", 0x02BC: "'"}
_WIDTHLESS = frozenset("​‌‍⁠﻿­")
_FOLDABLE = re.compile(f"[{re.escape(''.join(map(chr, _FOLD)))}]")
_HAS_WIDTHLESS = re.compile("[​‌‍⁠﻿­]")


def fold(text: str) -> tuple[str, list[int] | None]:
    """(folded text, places): widths, blanks, dashes and quotes unified; characters without width left out.

    ``places`` gives the place in the text of every folded character, None if it is the same.
    """
    if text.isascii():
        return text, None
    view = text.translate(_FOLD) if _FOLDABLE.search(text) else text
    if not _HAS_WIDTHLESS.search(view):
        return view, None
    keep = [i for i, c in enumerate(view) if c not in _WIDTHLESS]
    return "".join(view[i] for i in keep), keep


def lower(view: str) -> str:
    """Lower case of the same length."""
    low = view.lower()
    return low if len(low) == len(view) else "".join(c.lower() if len(c.lower()) == 1 else c for c in view)


class Names(NamedTuple):
    """A gazetteer: lower-case given names, family names with their particles, Chinese given names."""

    given: frozenset[str]
    family: frozenset[str]
    given_zh: frozenset[str]


COMMON = Names(frozenset(GIVEN), frozenset(FAMILY), frozenset(GIVEN_ZH))
_GIVEN_BEFORE = re.compile(r"(?<![\w@.\-+])([^\W\d_](?:[^\W\d_]|['\-])*)\s(?:[^\W\d_]\.?\s)?$")
_INITIALS_BEFORE = re.compile(r"(?<![\w@.\-+])(?:[^\W\d_]\.\s?){1,2}$")
_GIVEN_AFTER = re.compile(r",?\s([^\W\d_](?:[^\W\d_]|['\-])*)(?:\s[^\W\d_]\.)?(?![\w@\-+])")
_INITIAL_AFTER = re.compile(r",\s[^\W\d_]\.")
_TIED = frozenset("@.-+_")


class Finder:
    """The automaton and the parsers of a gazetteer."""

    def __init__(self, names: Names = COMMON):
        a = ahocorasick.Automaton()
        spoken = dict.fromkeys([*"|".join(DIGIT_WORDS).split("|"), *DIGITS_ZH])
        for kind, words in (
            ("at", AT), ("phone", PHONE_CUES), ("id", ID_CUES), *((f"street{i}", words) for i, words in enumerate(STREET_ANCHORS)), ("name", sorted(names.family)), ("zh", sorted(names.given_zh)), ("cue", NAME_CUES), ("digit", spoken), ("title", TITLES),
        ):
            for w in words:
                a.add_word(w, (*a.get(w, ()), (kind, len(w))))
        a.make_automaton()
        self.automaton, self.names = a, names

    def people(self, low: str, anchors: list[tuple[int, int]]) -> list[Span]:
        """Family names of the gazetteer, grown by a given name or initials on either side."""
        out, given = [], self.names.given
        for s, e in anchors:
            before, after = low[s - 1] if s else " ", low[e] if e < len(low) else " "
            if before.isalnum() or before in _TIED - {"."} or after.isalnum() or after in "@-+_":
                continue
            left = low[max(0, s - 40) : s]
            m = _GIVEN_BEFORE.search(left)
            if m and m.group(1) in given:
                out.append(Span("name", s - len(left) + m.start(), e))
                continue
            m = _INITIALS_BEFORE.search(left)
            if m:
                out.append(Span("name", s - len(left) + m.start(), e))
                continue
            if before == ".":
                continue
            m = _GIVEN_AFTER.match(low, e)
            if m and m.group(1) not in given and m.end() > m.end(1):  # what looked like an initial may end the sentence
                m = None
            if m and m.group(1) in given:
                out.append(Span("name", s, m.end()))
                continue
            m = _INITIAL_AFTER.match(low, e)
            if m:
                out.append(Span("name", s, m.end()))
        return out

    def people_zh(self, low: str, anchors: list[tuple[int, int]]) -> list[Span]:
        """Chinese given names of the gazetteer behind a family name."""
        return [Span("name", s - 1, e) for s, e in anchors if s and low[s - 1] in FAMILY_ZH]

    def find(self, text: str) -> list[Span]:
        """The personal data of a text, without overlaps, by start."""
        view, places = fold(text)
        low = lower(view)
        anchors: dict[str, list[tuple[int, int]]] = {}
        for last, kinds in self.automaton.iter(low):
            for kind, size in kinds:
                anchors.setdefault(kind, []).append((last - size + 1, last + 1))
        taken: list[Span] = []
        if "at" in anchors:
            taken = emails(low, anchors["at"])
        spoken = len(anchors.get("digit", ())) >= SPOKEN_LEAST
        streets = addresses(low, [i for i in range(len(ADDRESS)) if f"street{i}" in anchors])
        if spoken or _PAIR.search(low):
            taken = settle(taken, numbers(low, anchors.get("phone", []), anchors.get("id", []), streets, spoken))
        taken = settle(taken, streets)
        found = []
        if "name" in anchors:
            found = [x for x in settle([], self.people(low, anchors["name"])) if not _THING.match(view, x.end)]
        if "zh" in anchors:
            found = settle(found, self.people_zh(low, anchors["zh"]))
        for start, end in anchors.get("cue", ()):
            grown = _ANNOUNCED.match(low[start:end] + view[end : end + NAME_WINDOW])
            if grown:
                found.append(Span("name", grown.start(1) + start, grown.end(1) + start))
        at = 0
        for start, end in anchors.get("title", ()):
            if start < at or (start and low[start - 1].isalnum()) or low[end : end + 1] not in (".", " "):
                continue
            m = _TITLED.match(view, start)
            if m:
                at = m.end()
                last = m.group(1).split()[-1].lower()
                if view[m.start()].isupper() and not _NO_PERSON.match(view, m.end()) and not re.fullmatch(STREET_EN, last):
                    if all(m.end(1) <= x.start or m.start(1) >= x.end for x in found):  # the gazetteer knows where a name ends
                        found.append(Span("name", m.start(1), m.end(1)))
        if _HAN.search(low):
            found += [Span("name", m.start(1), m.end(1)) for m in _ZH_ANNOUNCED.finditer(low)]
        taken = settle(taken, found)
        taken.sort(key=lambda s: s.start)
        if places is None:
            return taken
        return [Span(k, places[s], places[e - 1] + 1) for k, s, e in taken]


def settle(taken: list[Span], more: list[Span]) -> list[Span]:
    """Adds the spans that overlap none of those taken before them."""
    out = list(taken)
    for s in sorted(more, key=lambda x: (x.start, -x.end)):
        if all(s.end <= t.start or s.start >= t.end for t in out):
            out.append(s)
    return out


def emails(low: str, anchors: list[tuple[int, int]]) -> list[Span]:
    """Grows at-signs, written or spoken, to whole addresses."""
    out: list[Span] = []
    for start, end in anchors:
        sign = low[start:end]
        spoken = sign[0] == " " or sign == "艾特"
        at = end
        while at < len(low) and low[at] == " " and at < end + 2:
            at += 1
        domain = (_DOMAIN if spoken or sign != "@" else _PLAIN_DOMAIN).match(low, at)
        if sign == "@" and not domain:
            domain = _DOMAIN.match(low, at)
        if not domain or _GOES_ON.match(low, domain.end()):
            continue
        stop = start
        while stop > 0 and low[stop - 1] == " " and stop > start - 2:
            stop -= 1
        left = low[max(0, stop - LOCAL_WINDOW) : stop]
        local = (_SPOKEN_LOCAL if spoken else _LOCAL).search(left)
        if not spoken and local and re.search(rf"{_SEP}$", left[: local.start()]):
            local = _SPOKEN_LOCAL.search(left) or local
        if not local:
            continue
        first = max(0, stop - LOCAL_WINDOW) + local.start()
        while low[first] in ".-'+%":
            first += 1
        if first < stop and (not out or first >= out[-1].end):
            out.append(Span("email", first, domain.end()))
    return out


def _cue_before(low: str, start: int, cues: list[tuple[int, int]]) -> int:
    """Distance from the nearest cue before a number in the same clause, or a large number."""
    best = 10**6
    for s, e in cues:
        if e <= start and start - e <= CUE_WINDOW and (s == 0 or not low[s - 1].isalnum() or low[s] >= "⺀"):
            if low[e - 1].isalpha() and low[e].isalpha() and low[s:e] in WHOLE_CUES:
                continue
            between = low[e:start].lstrip(" .:：-)")
            if not _CLAUSE_END.search(between):
                best = min(best, start - e)
    return best


def _cue_near(low: str, start: int, end: int, cues: list[tuple[int, int]]) -> int:
    """Distance from the nearest cue before a number, or, closer by, behind it in the same clause."""
    best = _cue_before(low, start, cues)
    for s, e in cues:
        if end <= s <= end + CUE_BEHIND and not low[s - 1].isalnum() and not (low[s:e] in WHOLE_CUES and low[e : e + 1].isalpha()) and not _CLAUSE_END.search(low[end:s]):
            best = min(best, s - end)
    return best


def _within(pattern: re.Pattern, low: str, ranges: list[tuple[int, int]]) -> Iterator[re.Match]:
    """The matches of a pattern inside rising ranges, without overlaps."""
    at = 0
    for a, b in ranges:
        for m in pattern.finditer(low, max(a, at), b):
            yield m
            at = m.end()


def numbers(low: str, phone_cues: list[tuple[int, int]], id_cues: list[tuple[int, int]], streets: list[Span], spoken: bool = True) -> list[Span]:
    """Telephone and identity numbers: by form, or by length with a cue before them; spoken digits by their number."""
    out: list[Span] = []
    # the numbers are looked for around clusters of digits only; a form may begin some letters before its first digit
    clusters = [(max(0, c.start() - LETTERS_FIRST), min(len(low), c.end() + 3)) for c in _CLUSTER.finditer(low) if sum(map(str.isdigit, c.group())) >= 6]
    for m in _within(_ID, low, clusters):
        near_id, near_phone = _cue_before(low, m.start(), id_cues), _cue_before(low, m.start(), phone_cues)
        letters_first = low[m.start()].isalpha()
        if near_phone < near_id and not letters_first:
            continue
        n = sum(c.isdigit() for c in m.group())
        if n < 9 and not letters_first and near_id > CUE_WINDOW and not low[m.end() - 1].isalpha():
            continue
        if n == 8 and not letters_first and near_id > CUE_WINDOW and "." not in m.group() and "-" not in m.group():
            continue
        out.append(Span("id_number", m.start(), m.end()))
    if id_cues:
        for m in _LETTERED_ID.finditer(low):
            if _cue_near(low, m.start(), m.end(), id_cues) <= CUE_WINDOW and sum(c.isdigit() for c in m.group()) >= 4:
                out.append(Span("id_number", m.start(), m.end()))
    for m in _within(_NUMBER, low, clusters):
        start, end = m.start(), m.end()
        if any(s.start < end and start < s.end for s in out) or any(s.start <= start < s.end for s in streets):
            continue
        body = m.group()
        n = sum(c.isdigit() for c in body)
        near_id, near_phone = _cue_before(low, start, id_cues), _cue_before(low, start, phone_cues)
        if near_id <= CUE_WINDOW and near_id <= near_phone and 7 <= n <= 18:
            if end < len(low) and re.match(r"[- ]?[a-z](?!\w)", low[end:]) and n <= 9:
                end += re.match(r"[- ]?[a-z]", low[end:]).end()
            out.append(Span("id_number", start, end))
            continue
        if near_phone <= CUE_WINDOW and 7 <= n <= 15 and not _DATE.match(body) and not _MARK.match(body):
            out.append(Span("phone", start, end))
            continue
        if not 7 <= n <= 40:
            continue
        at = start
        while at < end:
            p = _PHONE.match(low, at)
            if p and 8 <= sum(c.isdigit() for c in p.group()) <= 15 and (p.end() == len(low) or not (low[p.end()].isdigit() or (low[p.end()] in "/-" and low[p.end() + 1 : p.end() + 2].isalnum()))):
                if not (p.end() < len(low) and low[p.end()].isascii() and low[p.end()].isalpha()):
                    out.append(Span("phone", p.start(), p.end()))
                    break
            nxt = re.compile(r" [+(]{0,2}(?=\d)").search(low, at + 1, end)
            if not nxt:
                break
            at = nxt.start() + 1
    for pattern in _SPOKEN if spoken else ():
        for m in pattern.finditer(low):
            body = m.group().rstrip(" ,-")
            if any(s.start < m.end() and m.start() < s.end for s in out):
                continue
            near_id, near_phone = _cue_before(low, m.start(), id_cues), _cue_before(low, m.start(), phone_cues)
            out.append(Span("id_number" if near_id < near_phone else "phone", m.start(), m.start() + len(body)))
    return out


def addresses(low: str, forms: list[int]) -> list[Span]:
    """Street and house number, in those of the forms of eight languages whose street words the text holds."""
    out = []
    for i in forms:
        for m in ADDRESS[i].finditer(low):
            if i == 0 and not m.group()[0].isdigit():
                head = re.match(rf"{_NUM_EN}(?=\s)", m.group())
                several = re.match(rf"(?:{_NUM_EN}|a hundred|one hundred)[ \-](?:{_NUM_EN}|hundred|and)\b", m.group())
                if head and not several and not ADDRESS_CUE.search(low[: m.start()]):
                    continue
            if i == 1 and not m.group()[0].isdigit() and not ADDRESS_CUE.search(low[: m.start()]):
                continue
            out.append(Span("address", m.start(), m.end()))
    return out


@cache
def default_finder() -> Finder:
    """The finder of the common names, made once a process."""
    return Finder()


@cache
def _hints() -> ahocorasick.Automaton:
    """All that may stand before a name."""
    a = ahocorasick.Automaton()
    for w in {*NAME_CUES, *HINTS, *TITLES}:
        a.add_word(w, len(w))
    a.make_automaton()
    return a


def seeds(text: str) -> list[tuple[str, str, str]]:
    """(role, name, partner) of the names in a text that follow a cue, a hint or a title and have the shape of one.

    The role is given, family or zh; the partner is the other part, for initials the empty string.
    """
    view, _ = fold(text)
    low, out = lower(view), []
    for last, size in _hints().iter(low):
        start = last - size + 1
        then = _THEN.match(low, last + 1) if not start or not low[start - 1].isalnum() else None
        n = _SHAPE.match(view, then.end()) if then else None
        if not n or _NO_PERSON.match(view, n.end()):
            continue
        given, family = n["given"] or n["given_b"], n["family"] or n["family_b"] or n["family_c"]
        if given and (given.lower() in NO_GIVEN or family.split()[-1].lower() in NO_GIVEN) or re.fullmatch(STREET_EN, family.lower()):
            continue
        if given:
            out.append(("given", given.lower(), family.lower()))
        out.append(("family", family.lower(), (given or "").lower()))
    if _HAN.search(low):
        out += [("zh", m.group(2), m.group(1)) for m in _SEED_ZH.finditer(low)]
    return out


def learn_names(texts: DataFrame, base: Names = COMMON, partners: int = 3) -> Names:
    """The base gazetteer and the names of all texts (text): those that stand with at least ``partners`` different other
    parts where cues, hints or titles announce names. Names of things keep to one partner, names of people recombine.

    Only (role, name, partner) leaves a task, once each; what comes to the driver are names, at most ``MAX_NAMES``; more
    are refused, for then ``partners`` is too low for the corpus.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list({x for t in b.column(0).to_pylist() if t for x in seeds(t)})
            columns = list(zip(*found, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.string()) for c in columns], names=["role", "name", "partner"])

    found = texts.select("text").mapInArrow(scan, "role string, name string, partner string").distinct()
    known = found.groupBy("role", "name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= partners).select("role", "name")
    rows = known.limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names: raise the number of partners")
    by = {role: frozenset(r["name"] for r in rows if r["role"] == role) for role in ("given", "family", "zh")}
    return Names(base.given | by["given"], base.family | by["family"], base.given_zh | by["zh"])


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by the placeholder of its type; all else stays as it is."""
    out, at = [], 0
    for s in spans:
        out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join([*out, text[at:]])


FOUND = "item_kind string, item_id string, pii_type string, span_start int, span_end int"


def _finder_of(texts: DataFrame, names: Names | None):
    """A function that makes the finder of a gazetteer, sent to the tasks once."""
    if names is None:
        return default_finder
    shared = texts.sparkSession.sparkContext.broadcast(names)
    return lambda: Finder(shared.value)


def find_all(texts: DataFrame, names: Names | None = None) -> DataFrame:
    """(item_kind, item_id, pii_type, span_start, span_end): the personal data of (item_kind, item_id, text).

    Repeated rows give repeated spans; null and empty texts give none.
    """
    schema = pa.schema([("item_kind", pa.string()), ("item_id", pa.string()), ("pii_type", pa.string()), ("span_start", pa.int32()), ("span_end", pa.int32())])

    make = _finder_of(texts, names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = make()
        for b in batches:
            rows = [
                (k, i, s.kind, s.start, s.end)
                for k, i, t in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)
                if t
                for s in finder.find(t)
            ]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return texts.select("item_kind", "item_id", "text").mapInArrow(scan, FOUND)


def redact_all(texts: DataFrame, names: Names | None = None) -> DataFrame:
    """(item_kind, item_id, text, n_found): every row of (item_kind, item_id, text) with its personal data replaced.

    A null text stays null, with n_found 0.
    """
    schema = pa.schema([("item_kind", pa.string()), ("item_id", pa.string()), ("text", pa.string()), ("n_found", pa.int32())])

    make = _finder_of(texts, names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = make()
        for b in batches:
            texts = b.column(2).to_pylist()
            spans = [finder.find(t) if t else [] for t in texts]
            clean = [redact(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
            counts = pa.array([len(s) for s in spans], type=pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(clean, type=pa.string()), counts], schema=schema)

    return texts.select("item_kind", "item_id", "text").mapInArrow(scan, "item_kind string, item_id string, text string, n_found int")
