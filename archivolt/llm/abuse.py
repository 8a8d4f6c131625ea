"""Abusive, hateful or sexual content: gradient-boosted trees over dense features with isotonic calibration.

Every sentence of a text makes a vector: densities of general lexicons (insults, violence, groups, contempt, explicit
words, clinical words, second person), how near entries of two lexicons stand to each other, rates of capitals,
punctuation and obfuscation, and densities of a vocabulary that is learned per category from the review sample. Disguises
(letters set apart, stars, digits or signs for letters, stretched letters, other alphabets, full width, zero width) are
undone in the sentences that show traces of one. The trees alone decide; there is no margin or rule beside them.

Labels are of texts, not of sentences, so the fit is one of multiple instances: at first all sentences of a positive text
share its label, with a weight in proportion; then the sentence that trees of the other folds score highest stands for
its text, with less weight the less they believe in it, and the trees are fitted anew. The vocabulary's features are cross-fitted: those of a text come from the labels of the other
folds. A text's score is that of its highest sentence, calibrated on held-out folds.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivolt.llm import boosting
from archivolt.llm.tokens import clean_source

CATEGORIES = ("harassment", "hate", "sexual")
#: most labelled texts, and most characters of them, that are read for the fit
MAX_LABELS = 4_000
MAX_LABEL_CHARS = 32_000_000
THRESHOLD = 0.5
#: the review sample is rich in abuse: so many harmless texts of the corpus stand behind a harmless one of the sample
SAMPLED = 4.0
#: texts are read together in runs of about so many characters
RUN_CHARS = 400_000

# Lexicons of general vocabulary, entries parted by "|": stems at the beginning of a word ("=" in front: a whole word),
# Chinese ones anywhere. They are a parameter of fit().
LEXICONS = {
    "insult": (
        "asshole|arsehole|dumbass|jackass|scumbag|lowlife|halfwit|nitwit|dimwit|dickhead|shithead|dipshit|fuckwit|motherfucker|bastard|bitch|cunt|"
        "=prick|wanker|=twat|moron|douchebag|slimeball|shitbag|piece of shit|arschloch|vollidiot|drecksack|schwachkopf|wichser|hurensohn|"
        "dreckskerl|missgeburt|fotze|schlampe|mistkerl|mistkäfer|connard|connasse|salaud|salope|enculé|enfoiré|bâtard|fils de pute|"
        "cabrón|gilipollas|capullo|pendejo|hijo de puta|hijoputa|mamón|malnacid|desgraciad|cabrão|otário|filho da puta|arrombad|babaca|"
        "canalha|stronz|coglion|bastard|pezzo di merda|figlio di puttana|puttan|testa di cazzo|eikel|klootzak|hufter|mongool|kutwijf|teringlijer|"
        "kankerlijer|=lul|混蛋|白痴|废物|蠢货|傻逼|王八蛋|贱人|畜生|人渣|混账|婊子|脑残|狗东西"
    ),
    "mild": (
        "idiot|imbecil|imbécil|imbecille|cretin|crétin|cretino|loser|jerk|stupid|stupido|estúpid|=dumb|pathetic|worthless|useless|fool|clown|"
        "trottel|idioot|dummkopf|=dumm|wertlos|nutzlos|versager|lächerlich|ridicul|abruti|minable|bouffon|nul=|ordure|débile|incapable|inútil|tonto|tonta|"
        "payaso|fracasad|burro|palhaço|idiota|fracassad|scemo|scema|deficiente|pagliaccio|fallit|nutteloos|waardeloos|waardeloze|mislukkeling|"
        "sukkel|domkop|smeerlap|=pig|=ass|verme|笨蛋|蠢|垃圾|猪|没用|可悲"
    ),
    "violence": (
        "kill|murder|beat|=break|smash|stab|strangl|drown|bleed|=rot|=die|=dead|=choke|=hang|punch|crush|burn|töten|umbring|schlag|verreck|krepier|ersäuf|"
        "=tot|=bluten|zähne|fresse|tuer|crever|crève|casser|frapper|étrangl|noyer|saigner|=gueule|matar|=mato|parto|partir la cara|golpe|ahog|sangr|muér|muer|"
        "morre|quebr|afog|sangue|apodre|ammazz|uccid|spacc|crepa|marci|strozz|sangue|dood|vermoord|sla |slaan|verzuip|krepeer|bloed|去死|杀|打断|打死|弄死|死|掐"
    ),
    "dismissal": (
        "shut up|shut your|get lost|piss off|fuck off|go to hell|go away|halt die|halt's|verpiss|verschwinde|hau ab|ferme-la|ferme ta|ta gueule|dégage|va-t'en|casse-toi|"
        "cállate|cierra|lárgate|vete|cala a boca|cala-te|desaparece|some daqui|chiudi|stai zitto|sparisci|vattene|hou je|rot op|ga weg|闭嘴|滚"
    ),
    "disgust": (
        "disgust|sick|stink|ashamed|shame|hate|kotz|=ekel|ekelhaft|stinkst|stinkt|schäm|hasse|dégoût|=pues|puer|honte|déteste|asco|apest|vergüenza|odio|nojo|fedes|fede|"
        "vergonha|odeio|schifo|puzz|vergogn|odio|walg|stink|schaam|haat|恶心|讨厌|丢脸|臭"
    ),
    "group": (
        "migrant|immigrant|foreigner|refugee|believer|muslim|=jew|=jews|christian|=women|=gays|lesbian|disabled|cripple|gyps|=black|elderly|old people|=natives|"
        "ausländer|flüchtling|zuwanderer|behindert|=frauen|gläubig|juden|moslem|zigeuner|étranger|immigré|migrants|réfugié|handicapé|=femmes|croyant|=juifs|"
        "musulman|extranjer|inmigrante|migrante|refugiad|discapacitad|=mujeres|creyente|estrangeir|imigrante|deficientes|=mulheres|=crentes|stranier|immigrat|"
        "profugh|rifugiat|disabil|=donne|credenti|buitenlander|vluchteling|migrant|gehandicapt|=vrouwen|gelovig|移民|外地人|外国人|难民|残疾人|女人|信徒|老年人|老人|乡下人"
    ),
    "contempt": (
        "vermin|filth|subhuman|parasite|plague|=rats|=scum|=dirty|=animals|breed|infest|inferior|disease|=liars|=lie|criminal|steal|thiev|ungeziefer|dreck|"
        "abschaum|verlogen|schmarotz|=ratten|seuche|minderwert|vermine|racaille|parasite|=sale|=sales|=rats|fléau|voleur|basura|plaga|=ratas|escoria|parásit|"
        "ladron|=sucios|praga|lixo|escória|parasit|=ratos|ladr|feccia|parassit|=ratti|=sporc|ladri|ongedierte|tuig|=vies|uitschot|profiteur|害虫|下贱|低等|寄生虫|蛆|肮脏|骗"
    ),
    "exclusion": (
        "deport|expel|driven out|wiped out|wipe out|exterminat|eliminat|send them|go back|get rid|deserve|not belong|out of here|lock|vertreib|vertrieben|ausrott|"
        "abschieb|verdienen|raus hier|chasser|chassé|expuls|extermin|mérit|dehors|echar|expuls|merec|fuera de|extermin|expulsos|fora daqui|cacci|stermin|merit|"
        "verdrijv|uitroei|verdien|=weg|赶走|滚回|消灭|驱逐|不配"
    ),
    "explicit": (
        "fuck|pussy|porn|blowjob|handjob|=nudes|=cum|=cock|dick|=tits|horny|orgasm|masturbat|ficken|fickt|gefickt|=geil|schwanz|titten|wichs|baiser|baisait|"
        "branle|bande|bite|chatte|sucer|follar|follán|=polla|=coño|=tetas|chupar|fodê|foder|fode|=pau|=buceta|chupar|scopar|scopat|=cazzo|=figa|pompin|"
        "neuken|geneukt|=geile|pijpen|=kut|做爱|操你|性交|淫|鸡巴|口交"
    ),
    "body": (
        "naked|nude|breast|strip|=lick|=suck|=ride|spread|knees|=legs|moan|begged|clothes|undress|nackt|brust|=akt|auszieh|=beine|stöhn|=nue|=nues|=nu|=sein|=seins|"
        "jambes|désha|desnud|pecho|piernas|=gemía|=nua|=nu|=peito|pernas|despi|nuda|nudo|=seno|gambe|spogli|naakt|borst|benen|kreun|裸|脱光|乳|胸|腿|呻吟"
    ),
    "clinical": (
        "cancer|screening|hospital|clinic|patient|doctor|medical|surgery|tumour|disease|therapy|examin|krebs|klinik|krankenhaus|arzt|ärzt|medizin|"
        "hôpital|dépistage|médic|médecin|hospital|médic|clínic|cribado|ospedale|medic|clinica|ziekenhuis|arts|medisch|kanker|癌|医院|医生|检查|病"
    ),
    "neutral_use": (
        "process|server|script|database|dictionary|definition|quote|film|painting|sculpture|drawing|museum|farm|crow|plant|frost|garden|recipe|cellar|trap|welcome|"
        "recorded|series|equal|prozess|gemälde|zeichnung|museum|willkommen|garten|processus|tableau|sculpture|bienven|musée|jardin|proceso|cuadro|museo|bienvenid|"
        "jardín|processo|quadro|museu|bem-vind|scultura|benvenut|museo|schilderij|welkom|tuin|进程|博物馆|欢迎|画|农场|花园"
    ),
    "second": (
        "=you|=your|=yours|=yourself|=u|=du|=dir|=dich|=dein|=deine|=deinen|=euch|=ihr|=tu|=te|=toi|=ton|=ta|=tes|=vous|=votre|=eres|=tú|=ti|=usted|=você|=teu|=tua|"
        "=és|=sei|=tuo|=je|=jij|=jou|=jouw|=bent|你|您"
    ),
}
NAMES = tuple(LEXICONS)
_N = {n: i for i, n in enumerate(NAMES)}
#: pairs of sets of lexicons whose nearness is a feature
NEAR = (
    (("insult", "mild"), ("second",)), (("violence",), ("second",)), (("dismissal", "disgust"), ("second",)), (("explicit", "body"), ("second",)),
    (("contempt", "exclusion"), ("group",)), (("insult", "mild", "violence"), ("group",)), (("explicit",), ("body",)),
    (("explicit", "body"), ("clinical", "neutral_use")), (("contempt", "group"), ("neutral_use",)),
)
#: lexicons whose entries a disguise may hide
TELLING = frozenset(_N[n] for n in NAMES if n not in ("second", "clinical", "neutral_use"))
FEATURES = (
    *NAMES,
    *("+".join(a) + " near " + "+".join(b) for a, b in NEAR),
    "capitals", "punctuation", "obfuscation", "disguised_hits",
    *(f"{c} vocabulary {how}" for c in (*CATEGORIES, "harmless") for how in ("sum", "most", "share")),
)
#: learned vocabularies: one per category, and one of harmless sentences that look like abuse
VOCABULARIES = len(CATEGORIES) + 1
FIXED = len(FEATURES) - 3 * VOCABULARIES
#: a word joins the vocabulary of a category with at least so many positive sentences and so much log-odds
MIN_SEEN, MIN_ODDS, MAX_ODDS = 2, 2.0, 6.0
#: weight of all sentences of a harmless text but its highest, which weighs 1
REST = 1.0

# fixed values: letters of other alphabets that look like Latin ones, and signs used for letters
LOOKALIKE = str.maketrans("аеорсхукіѕјԁмтнвαεορτυιχγѵԛѡ", "aeopcxykisjdmthbaeoptuixyvqw")
LEET = str.maketrans("013457@$!|€", "oieastasile")
ZERO_WIDTH = "​‌‍‎‏⁠﻿­"
_NO_WIDTH = {ord(c): None for c in ZERO_WIDTH}
_ODD = re.compile(rf"[{ZERO_WIDTH}！-～Ѐ-ӿͰ-Ͽ]")
_APART = re.compile(r"(?<!\w)[^\W\d_](?:([ .\-_])[^\W\d_])(?:\1[^\W\d_]){2,}(?!\w)")
_STRETCH = re.compile(r"([^\W\d_])\1\1+")
#: signs between letters, letters between signs, a sign at either end of three letters or more
_LEET = re.compile(r"[^\W\d_][0-9@$!|€]+[^\W\d_]|(?<!\w)[0-9@$]+[^\W\d_]+[0-9@$]+[^\W\d_]|(?<![\w@$])[0-9@$!|€][^\W\d_]{3}|[^\W\d_]{3}[0-9@$|€](?!\w)")
_MIXED = re.compile(r"(?<![\w@$])(?=[\w@$!|€]*[^\W\d_])(?=[\w@$!|€]*[0-9@$!|€])[\w@$!|€][\w@$|€]*(?:![\w@$|€]+)*")
_STAR = re.compile(r"[^\W_]*\*+[^\W_]+(?:\*+[^\W_]+)*")
_BLANK = re.compile(r"[\W_]")
_TOKEN = re.compile(r"[^\W_]+")
_WIDE_FROM = "⺀"


# classes of code points, one bit each
_CLASSES = ("upper", "alpha", "alnum", "space", "loud", "stop", "wide_stop", "wide", "odd", "sign", "apart")
_BIT = {name: np.uint16(1 << i) for i, name in enumerate(_CLASSES)}


@cache
def _class_table() -> np.ndarray:
    """The classes of the code points below 0x20000; those beyond count as the last of them."""
    out = np.zeros(0x20000, dtype=np.uint16)
    for c in range(0x20000):
        s = chr(c)
        out[c] = s.isupper() | s.isalpha() << 1 | s.isalnum() << 2 | s.isspace() << 3
    at = np.arange(0x20000)
    members = {
        "loud": np.isin(at, [ord(c) for c in "!?！？…"]), "stop": np.isin(at, [ord(c) for c in ".!?"]), "wide_stop": np.isin(at, [ord(c) for c in "。\n"]),
        "wide": (at >= ord(_WIDE_FROM)) & ((out & _BIT["alpha"]) > 0), "odd": ((at >= 0x370) & (at <= 0x4FF)) | np.isin(at, [ord(c) for c in ZERO_WIDTH]),
        "sign": np.isin(at, [ord(c) for c in "0123456789@$!|€"]), "apart": np.isin(at, [ord(c) for c in " .-_"]),
    }
    for name, mask in members.items():
        out[mask] |= _BIT[name]
    return out


def _classes(cp: np.ndarray):
    """A look-up of the classes of code points: f(name) is a mask."""
    found = _class_table()[np.minimum(cp, 0x1FFFF)]
    return lambda name: (found & _BIT[name]) != 0


def _strip_accents(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


def entries(lexicon: str) -> list[tuple[str, bool]]:
    """(entry, whole word) of a lexicon."""
    return [(e.strip("="), "=" in e) for e in lexicon.split("|")]


def _lower(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Matcher:
    """All lexicon entries, and the words of a learned vocabulary behind them, in one automaton over spaced text."""

    def __init__(self, lexicons: dict[str, str], vocabulary: list[str] | tuple[str, ...] = ()):
        found: dict[str, set[int]] = {}
        for name, i in _N.items():
            for entry, whole in entries(lexicons.get(name, "")):
                for form in {entry, _strip_accents(entry)} - {""}:
                    found.setdefault(self._key(form, whole), set()).add(i)
        for i, word in enumerate(vocabulary):
            found.setdefault(self._key(word, True), set()).add(len(NAMES) + i)
        self.automaton = ahocorasick.Automaton()
        for entry, kinds in found.items():
            self.automaton.add_word(entry, (len(entry) - 1 - entry.startswith(" "), tuple(kinds)))
        if found:
            self.automaton.make_automaton()

    @staticmethod
    def _key(entry: str, whole: bool) -> str:
        if entry[0] >= _WIDE_FROM:
            return entry
        return " " + "".join(c if c.isalnum() else " " for c in entry) + (" " if whole else "")

    def hits(self, spaced: str) -> tuple[list[int], list[int]]:
        """(kinds, starts) of all entries in a text of ``spaced``. Kinds from ``len(NAMES)`` on are words of the vocabulary."""
        kinds: list[int] = []
        starts: list[int] = []
        if not len(self.automaton):
            return kinds, starts
        for last, (back, of) in self.automaton.iter(spaced):
            for k in of:
                kinds.append(k)
                starts.append(last - back)
        return kinds, starts


def spaced(low: str) -> str:
    """A lower-case text with a blank for all that is no letter or digit, and a blank on either side."""
    return " " + _BLANK.sub(" ", low) + " "


def undisguise(s: str, matcher: Matcher) -> tuple[str, int]:
    """The lower-case sentence with disguises undone, and how many there were."""
    count = 0
    if not s.isascii() and _ODD.search(s):
        plain = unicodedata.normalize("NFKC", s).translate(_NO_WIDTH)
        if any("a" <= c <= "z" for c in plain):
            plain = plain.translate(LOOKALIKE)
        count += 1
        s = plain.lower()
    joined, n = _APART.subn(lambda m: re.sub(r"[ .\-_]", "", m.group()), s)
    short, k = _STRETCH.subn(r"\1", joined)
    count += n + k

    def telling(word: str) -> bool:
        return any(kind in TELLING or kind >= len(NAMES) for kind in matcher.hits(spaced(word))[0])

    def leet(m: re.Match) -> str:
        nonlocal count
        t = m.group()
        if sum(c.isdigit() for c in t) > 5 or len(t) > 24:
            return t
        word = t.translate(LEET)
        if not telling(word):
            return t
        count += 1
        return word

    def star(m: re.Match) -> str:
        nonlocal count
        t = m.group()
        for c in "aeiouéáíóäöüuc":
            w = t.replace("*", c)
            if telling(w):
                count += 1
                return w
        return t

    out = _MIXED.sub(leet, short) if _LEET.search(short) else short
    if "*" in out:
        out = _STAR.sub(star, out)
    return out, count


def disguise_traces(low: np.ndarray) -> np.ndarray:
    """Which code points of a lower-case text may begin a disguise: a sign or digits between letters or at either end of
    three, a star at a letter, a letter three times in a row, four single letters set apart alike, odd characters."""
    of, n, cp = _classes(low), len(low), low
    letter, sign, word = of("alpha"), of("sign"), of("alnum") | (cp == 95)
    ahead = lambda m, k: np.concatenate((m[k:], np.zeros(min(k, n), dtype=m.dtype)))
    behind = lambda m, k: np.concatenate((np.zeros(min(k, n), dtype=m.dtype), m[: max(0, n - k)]))
    out = of("odd") | (letter & (ahead(cp, 1) == cp) & (ahead(cp, 2) == cp))
    star = cp == 42
    if star.any():
        out |= star & ahead(word, 1)
    first = np.flatnonzero(sign & ~behind(sign, 1))
    last = np.flatnonzero(sign & ~ahead(sign, 1))
    at = lambda m, i: np.where((i >= 0) & (i < n), m[np.clip(i, 0, max(0, n - 1))], False)
    left, right = at(letter, first - 1), at(letter, last + 1)
    before = ~left & ~at(word, first - 1) & right & at(letter, last + 2) & at(letter, last + 3)
    after = left & at(letter, first - 2) & at(letter, first - 3) & ~at(word, last + 1) & (cp[last] != 33)
    out[first[(left & right) | before | after]] = True
    apart = of("apart")
    pair = letter & ahead(apart, 1) & ahead(letter, 2)
    same = pair & ahead(pair, 2) & ahead(pair, 4) & (ahead(cp, 1) == ahead(cp, 3)) & (ahead(cp, 1) == ahead(cp, 5))
    return out | (same & ~behind(word, 1) & ~ahead(word, 7))


@dataclass
class Sentences:
    """The sentences of some texts: ``first[i]:first[i+1]`` are those of text i; hits of the vocabulary as parallel arrays."""

    x: np.ndarray
    words: np.ndarray
    first: np.ndarray
    hit_sentence: np.ndarray
    hit_word: np.ndarray
    plain: list[str]


def _nearness(sentence: np.ndarray, place: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """By sentence, 1 / (1 + d / 20) for the least distance d of an a from a b, 0 where either is missing."""
    out = np.zeros(n)
    if not a.any() or not b.any():
        return out
    key = sentence * (1 << 32) + place
    of_a, of_b = key[a], np.sort(key[b])
    at = np.searchsorted(of_b, of_a)
    for side in (np.clip(at - 1, 0, len(of_b) - 1), np.clip(at, 0, len(of_b) - 1)):
        other = of_b[side]
        same = (other >> 32) == (of_a >> 32)
        np.maximum.at(out, (of_a >> 32)[same], 1.0 / (1.0 + np.abs(other - of_a)[same] / 20.0))
    return out


def read(texts: list[str], matcher: Matcher, keep_plain: bool = False) -> Sentences:
    """Vectors of all sentences of the texts, the vocabulary's features still zero; every text has at least one."""
    cp = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    full = (cp >= 0xFF01) & (cp <= 0xFF5E)  # full width is of one length with plain, so it is undone at once
    cp = np.where(full, cp - 0xFEE0, cp)
    low = _lower(cp.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"))
    of = _classes(cp)
    alnum, alpha = of("alnum"), of("alpha")
    followed = np.append(of("space")[1:], True) | full
    ends = np.flatnonzero(of("wide_stop") | (of("stop") & followed)) + 1
    starts = np.concatenate(([0], ends[:-1]))
    n = len(ends)
    first = np.concatenate(([0], np.searchsorted(ends, np.cumsum([len(t) + 1 for t in texts])) + 1)).astype(np.int64)

    def total(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask, starts, dtype=np.int32) if n else np.zeros(0, dtype=np.int32)

    words = np.maximum(1, np.maximum(total(alnum & ~np.concatenate(([False], alnum[:-1]))), total(of("wide")) // 2))
    low_cp = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    between = np.concatenate(([32], np.where(alnum, low_cp, 32))).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    kinds, at = (np.array(v, dtype=np.int64) for v in matcher.hits(between))
    at -= 1
    sentence = np.searchsorted(starts, at, side="right") - 1
    spots = np.searchsorted(starts, np.flatnonzero(disguise_traces(low_cp)), side="right") - 1
    obfuscation, uncovered = (total(full & alnum) > 0).astype(np.float64), np.zeros(n)
    undone: dict[int, str] = {}
    more: list[tuple[int, int, int]] = []
    for s in np.unique(spots).tolist():  # sentences with traces of a disguise are read once more without it
        plain, count = undisguise(low[starts[s] : ends[s]], matcher)
        if count:
            undone[s] = plain
            obfuscation[s] += count
            more += [(k, s, p) for k, p in zip(*matcher.hits(spaced(plain)), strict=True)]
    if undone:
        again = np.isin(sentence, list(undone))
        np.add.at(uncovered, sentence[again & np.isin(kinds, list(TELLING))], -1)
        fresh = np.array(more, dtype=np.int64).reshape(-1, 3)
        np.add.at(uncovered, fresh[np.isin(fresh[:, 0], list(TELLING)), 1], 1)
        kinds = np.concatenate((kinds[~again], fresh[:, 0]))
        at = np.concatenate((at[~again], fresh[:, 2] + starts[fresh[:, 1]]))
        sentence = np.concatenate((sentence[~again], fresh[:, 1]))
    x = np.zeros((n, len(FEATURES)))
    root = np.sqrt(words)
    known = kinds < len(NAMES)
    counts = np.bincount(sentence[known] * len(NAMES) + kinds[known], minlength=n * len(NAMES)).reshape(n, len(NAMES))
    x[:, : len(NAMES)] = counts / root[:, None]
    column = len(NAMES)
    for a, b in NEAR:
        x[:, column] = _nearness(sentence, at, np.isin(kinds, [_N[v] for v in a]), np.isin(kinds, [_N[v] for v in b]), n)
        column += 1
    x[:, column] = total(of("upper")) / np.maximum(1, total(alpha))
    x[:, column + 1] = total(of("loud")) / words
    x[:, column + 2] = obfuscation / words
    x[:, column + 3] = np.maximum(0, uncovered)
    plain = [undone.get(s) or low[a:b] for s, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True))] if keep_plain else []
    return Sentences(x, words, first, sentence[~known], kinds[~known] - len(NAMES), plain)


def _vocabulary_features(x: np.ndarray, words: np.ndarray, sentence: np.ndarray, word: np.ndarray, odds: np.ndarray) -> None:
    """Fills in the features of a vocabulary with (words, VOCABULARIES) log-odds, zero for words of no use to one."""
    n, root = len(x), np.sqrt(words)
    for c in range(VOCABULARIES):
        w = odds[word, c] if len(odds) else np.zeros(0)
        sums = np.bincount(sentence, weights=w, minlength=n)
        most = np.zeros(n)
        np.maximum.at(most, sentence, w)
        x[:, FIXED + 3 * c] = sums / root
        x[:, FIXED + 3 * c + 1] = most
        x[:, FIXED + 3 * c + 2] = np.bincount(sentence, weights=w > 0, minlength=n) / root


@dataclass
class Model:
    """Lexicons, learned vocabulary, trees and calibration by category."""

    lexicons: dict[str, str]
    vocabulary: list[str]
    odds: np.ndarray
    trees: list[boosting.Boosted]
    steps: list[tuple[np.ndarray, np.ndarray]]

    def matcher(self) -> Matcher:
        return Matcher(self.lexicons, self.vocabulary)

    def vectors(self, texts: list[str], matcher: Matcher) -> tuple[np.ndarray, np.ndarray]:
        """(vectors of all sentences, first sentence of every text and one past the last)."""
        s = read(texts, matcher)
        _vocabulary_features(s.x, s.words, s.hit_sentence, s.hit_word, self.odds)
        return s.x, s.first

    def scores(self, texts: list[str], matcher: Matcher) -> np.ndarray:
        """(texts, categories) calibrated probabilities."""
        out, begin, size = [np.zeros((0, len(CATEGORIES)))], 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= RUN_CHARS or i == len(texts) - 1:
                x, first = self.vectors(texts[begin : i + 1], matcher)
                tops = [boosting.calibrate(np.maximum.reduceat(t.margin(x), first[:-1]), s) for t, s in zip(self.trees, self.steps, strict=True)]
                out.append(np.stack(tops, axis=1))
                begin, size = i + 1, 0
        return np.concatenate(out)


def _words(plain: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(sentence, word number, words) of all words of all sentences; pairs of neighbours for scripts without blanks."""
    numbers: dict[str, int] = {}
    sentence, word = [], []
    for i, s in enumerate(plain):
        for t in _TOKEN.findall(s):
            if t[0] >= _WIDE_FROM or t[-1] >= _WIDE_FROM:
                parts = [t[k : k + 2] for k in range(len(t) - 1) if t[k] >= _WIDE_FROM and t[k + 1] >= _WIDE_FROM]
            else:
                parts = [t]
            for p in parts:
                sentence.append(i)
                word.append(numbers.setdefault(p, len(numbers)))
    return np.array(sentence, dtype=np.int64), np.array(word, dtype=np.int64), list(numbers)


def _log_odds(sentence: np.ndarray, word: np.ndarray, n_words: int, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """By word, the log-odds of standing in a good rather than a bad sentence (boolean by sentence), 0 below the bounds."""
    p = np.bincount(word[good[sentence]], minlength=n_words).astype(np.float64)
    q = np.bincount(word[bad[sentence]], minlength=n_words).astype(np.float64)
    odds = np.log((p + 0.5) / (good.sum() + 1.0)) - np.log((q + 0.5) / (bad.sum() + 1.0))
    return np.where((p >= MIN_SEEN) & (odds >= MIN_ODDS), np.minimum(odds, MAX_ODDS), 0.0)


def fit(rows: list[tuple[str, int, str | None]], lexicons: dict[str, str] | None = None, folds: int = 4, turns: int = 3) -> Model:
    """Fits (text, is_abusive, category) rows. A positive of unknown or another category says nothing about a category
    but that the sentence which stands for it there is none of it. The folds follow the texts, so equal texts share one."""
    lexicons = lexicons or LEXICONS
    s = read([t for t, _, _ in rows], Matcher(lexicons), keep_plain=True) if rows else None
    if s is None:
        grid = np.linspace(-8, 8, 33)
        return Model(lexicons, [], np.zeros((0, VOCABULARIES)), [boosting.boost(np.zeros((0, len(FEATURES))), np.zeros(0)) for _ in CATEGORIES], [(grid, boosting.sigmoid(grid))] * len(CATEGORIES))
    n, n_texts = len(s.x), len(rows)
    text_of = np.repeat(np.arange(n_texts), np.diff(s.first))
    fold = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % folds for t, _, _ in rows])
    bad = np.array([bool(b) for _, b, _ in rows])
    of = [np.array([bool(b) and c == category for _, b, c in rows]) for category in CATEGORIES]
    size = np.diff(s.first)[text_of]
    word_sentence, word, names = _words(s.plain)
    pairs = np.unique(word_sentence * max(1, len(names)) + word)
    once = pairs // max(1, len(names)), pairs % max(1, len(names))
    crossed = s.x.copy()
    # by category: sentences that stand for a positive text and their weights; weights of the sentences of harmless texts
    stands = [np.where(of[c][text_of], 1.0 / size, 0.0) for c in range(len(CATEGORIES))]
    against = [np.where(bad[text_of], 0.0, 1.0 / size) for _ in CATEGORIES]

    def trained(c: int, inside: np.ndarray) -> boosting.Boosted:
        """The trees of a category on some of the texts; what stands for another category is none of this one."""
        less = against[c].copy()
        for o in range(len(CATEGORIES)):
            if o != c:
                less = np.maximum(less, np.where(of[c][text_of] | (stands[o] < 0.5), 0.0, stands[o]))
        at = np.flatnonzero(((stands[c] > 0) | (less > 0)) & inside[text_of])
        y = (stands[c][at] > 0).astype(np.float64)
        return boosting.boost(crossed[at], y, np.where(y > 0, stands[c][at], less[at]))

    def vocabulary(inside: np.ndarray) -> np.ndarray:
        within = inside[text_of]
        fine = ~bad[text_of] & within
        hard = fine & (np.max(against, axis=0) >= 1.0) & (size > 1)
        pairs = [((stands[c] >= 0.5) & within, fine) for c in range(len(CATEGORIES))] + [(hard, fine & ~hard)]
        return np.stack([_log_odds(*once, len(names), good, less) for good, less in pairs], axis=1)

    everything, tops = np.ones(n_texts, dtype=bool), np.zeros((n_texts, len(CATEGORIES)))
    for turn in range(turns + 1):
        margins = []
        for c in range(len(CATEGORIES)):
            margin = np.zeros(n)
            if turn == 0:
                margin = trained(c, everything).margin(crossed)
            else:
                for k in range(folds):
                    mine = fold[text_of] == k
                    margin[mine] = trained(c, fold != k).margin(crossed[mine])
            margins.append(margin)
        for c, margin in enumerate(margins):
            best = np.lexsort((-margin, text_of))[s.first[:-1]]
            tops[:, c] = margin[best]
            if turn == turns:
                continue
            stands[c], against[c] = np.zeros(n), np.where(bad[text_of], 0.0, REST / size)
            good = best[of[c]]
            stands[c][good] = 1.0 if turn == 0 else np.maximum(0.05, boosting.sigmoid(margin[good] + 1.0))
            against[c][best[~bad]] = 1.0
        if turn < turns:
            for k in range(folds):
                mine = np.flatnonzero(fold[text_of] == k)
                here = fold[text_of[word_sentence]] == k
                block = s.x[mine].copy()
                _vocabulary_features(block, s.words[mine], np.searchsorted(mine, word_sentence[here]), word[here], vocabulary(fold != k))
                crossed[mine] = block
    odds = vocabulary(everything)
    finals = [trained(c, everything) for c in range(len(CATEGORIES))]
    steps = []
    for c in range(len(CATEGORIES)):
        own = ~bad | of[c]
        ys = of[c][own].astype(np.float64)
        if ys.min(initial=1.0) < ys.max(initial=0.0):
            steps.append(boosting.isotonic(tops[own, c], ys, SAMPLED))
        else:  # nothing to calibrate on: the margins are taken as they are
            grid = np.linspace(-8, 8, 33)
            steps.append((grid, boosting.sigmoid(grid)))
    kept = np.flatnonzero(odds.any(axis=1))
    return Model(lexicons, [names[i] for i in kept], odds[kept], finals, steps)


def fit_labels(texts: DataFrame, labels: DataFrame, lexicons: dict[str, str] | None = None) -> Model:
    """Fits the review sample (item_kind, item_id, is_abusive, category) on its texts.

    At most ``MAX_LABELS`` labelled items of together ``MAX_LABEL_CHARS`` characters are read, in order of a hash. An item
    labelled twice counts by its largest label. Labels without a text are left out.
    """
    wanted = (
        labels.where("is_abusive is not null and item_id is not null")
        .groupBy("item_kind", "item_id")
        .agg(F.max("is_abusive").alias("bad"), F.max("category").alias("category"))
        .withColumn("rank", F.xxhash64("item_kind", "item_id"))
        .orderBy("rank", "item_kind", "item_id")
        .limit(MAX_LABELS)
    )
    found = (
        texts.where("text is not null")
        .join(F.broadcast(wanted), ["item_kind", "item_id"])
        .dropDuplicates(["item_kind", "item_id"])
        .withColumn("upto", F.sum(F.length("text").cast("bigint")).over(Window.orderBy("rank", "item_kind", "item_id")))
        .where(F.col("upto") <= MAX_LABEL_CHARS)
        .select("text", "bad", "category", "item_kind", "item_id")
    )
    rows = sorted(found.collect(), key=lambda r: (r.item_kind, r.item_id))
    return fit([(r.text, r.bad, r.category) for r in rows], lexicons)


SCORES = "item_kind string, item_id string, source string, harassment double, hate double, sexual double"


def score(texts: DataFrame, model: Model) -> DataFrame:
    """(item_kind, item_id, source, harassment, hate, sexual): a score per category of every row of
    (item_kind, item_id, source, text). A null or empty text scores like one in which nothing is found."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema(
        [("item_kind", pa.string()), ("item_id", pa.string()), ("source", pa.string()), *((c, pa.float64()) for c in CATEGORIES)]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        matcher = model.matcher()
        for b in batches:
            s = model.scores([t or "" for t in b.column(3).to_pylist()], matcher)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(s[:, i]) for i in range(len(CATEGORIES)))], schema=schema)

    return texts.select("item_kind", "item_id", "source", "text").mapInArrow(scan, SCORES)


def found_categories(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_kind, item_id, category): the categories whose score reaches the threshold."""
    each = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("score")) for c in CATEGORIES])
    return (
        scores.select("item_kind", "item_id", F.inline(each)).where(F.col("score") >= threshold)
        .select("item_kind", "item_id", "category").distinct()
    )


def source_rates(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(source, n_docs, and by category the share of documents found and the mean score) over documents."""
    docs = scores.where("item_kind = 'document'").withColumn("source", F.coalesce(clean_source(F.col("source")), F.lit("unknown")))
    return docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"),
        *[F.avg((F.col(c) >= threshold).cast("double")).alias(f"{c}_rate") for c in CATEGORIES],
        *[F.avg(c).alias(f"{c}_mean") for c in CATEGORIES],
    )
