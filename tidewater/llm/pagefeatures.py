"""Features of a page's own content that tell sentences from keywords, links and tags."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter

import numpy as np

# Function words of seven languages. Words that keyword phrases use ("for sale", "sans dépôt") are left out.
FUNCTION_WORDS: dict[str, frozenset[str]] = {
    "en": frozenset("the a an and or but if then that this these those is are was were be been it its they we you who which what when where why how has have had not than more of to in on at by with from as about until before after there some any will would may can cannot".split()),
    "de": frozenset("der die das den dem des ein eine einen einem einer und oder aber wenn dann dass ist sind war waren wird werden nicht als mehr von zu zum zur im am auf bei mit aus an für um über bis vor nach so sich es sie wir ihr wie warum was man noch hat haben blieb".split()),
    "fr": frozenset("le la les un une des du et ou mais si que qui est sont était soit plus à au aux dans sur par avec pour en il elle on nous vous ce cette ces se sa son ses leur ne où comment pourquoi après avant depuis selon bien près".split()),
    "es": frozenset("el la los las un una unas y o pero si que es son era se al del por con para más su sus nos le lo como cuando dónde sobre entre antes tras hasta según nadie ha han aunque sabe parezca todo este esta".split()),
    "ru": frozenset("и в во на с со что как по к у из за от до о об не но или если то же это его её их был была было были есть будет чтобы прежде чем хотя почему никто здесь говорят около после перед прошлой тот который всегда".split()),
    "pl": frozenset("i w we na z ze że jak po od o u za dla nie ale lub jeśli to jest są był była było były się przed czy gdy choć dlaczego nikt zanim tu co ma mają około zawsze zeszłej podczas".split()),
}
# Small words that keyword phrases use as well; they speak neither for nor against a sentence.
NEUTRAL_WORDS = frozenset("for no me near free ohne de en sin sans pas bez do без".split())

# Labels of site menus and footers, in lower case.
MENU_LABELS = frozenset(
    w.strip()
    for w in """home, search, contact, about us, imprint, weather, careers, help, news, archive, markets, register, login, topics, shop, newsletter, my account, print, back to top, share this page, terms of use, privacy, settings, reject, accept all, manage choices, menu,
datenschutz, anmelden, nachrichten, warenkorb, wetter, themen, über uns, impressum, suche, agb, kontakt, märkte, archiv, hilfe, startseite, seite drucken, nach oben, einstellungen, ablehnen, alle akzeptieren,
archives, panier, accueil, aide, connexion, marchés, actualités, météo, mentions légales, recherche, à propos, haut de page, imprimer, conditions, confidentialité, tout accepter, paramétrer, refuser,
el tiempo, buscar, noticias, mercados, contacto, ayuda, acceder, inicio, aviso legal, archivo, carrito, quiénes somos, aceptar todo, configurar, rechazar, condiciones, privacidad, volver arriba,
о нас, погода, новости, темы, главная, помощь, войти, архив, рынки, контакты, поиск, корзина, условия, конфиденциальность, принять все, настройки, наверх, печать,
pomoc, o nas, koszyk, pogoda, szukaj, rynki, archiwum, strona główna, zaloguj się, wiadomości, regulamin, prywatność, akceptuj wszystko, ustawienia, drukuj, do góry,
ログイン, 会社案内, ヘルプ, カート, ホーム, すべて許可, 市場, ニュース, 天気, 検索, お問い合わせ, 設定, 過去の記事, 利用規約, 個人情報, ページの先頭へ, 印刷""".replace("\n", " ").split(",")
)
# Words that mark a sentence as a cookie notice, a footer or an invitation to subscribe, in lower case.
NOTICE_WORDS = tuple(
    w.strip()
    for w in """cookie, クッキー, your device, ihrem gerät, votre appareil, su dispositivo, データの保存, обработки данных, zapis danych, privacy matters,
all rights reserved, rechte vorbehalten, droits réservés, derechos reservados, права защищены, prawa zastrzeżone, 無断転載, subscribe to our, rundbrief, notre lettre,
nuestro boletín, нашу рассылку, do biuletynu, メールマガジン, notre politique, nuestra política, datenschutzerklärung""".replace("\n", " ").split(",")
)

_ZERO_WIDTH = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad]")
_SENTENCE = re.compile(r"\n+|(?<=[.!?…])\s+|(?<=[。！？])")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_LINK = re.compile(r"(?:https?://|www\.)\S+|\b[\w-]+\.example\S*", re.IGNORECASE)
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")
# Japanese particles, and the hiragana endings that hold a sentence together.
_PARTICLE = re.compile(r"[はがをにでともへやのなか]|.*(?:した|れた|った|らせた|えた|いる|する|ある|ない|いの|だが?|です|ます|のか|という|ので|から|まで|までに|には|では|とは|ること|いた)")
_KANA = re.compile(r"[\u3040-\u309f]")
_SCRIPT_RUN = re.compile(r"[\u3040-\u309f]+|[\u30a0-\u30ff]+|[\u3400-\u9fff]+")
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_] ){4,}[^\W\d_](?!\S)")
_LEET = re.compile(r"\w*(?:[^\W\d][0-9$@]|[0-9$@][^\W\d])[\w$@]*")
_SEPARATOR = re.compile(r"[,;|/•·»–#>!]| - ")
_LOST = "\u0223"  # a letter that none of the languages uses
_DIGITS = frozenset("0123456789")
_ENDS = tuple(".?…。？！")
_MENU = re.compile(
    r"(?<![^\s|,·•])(?:%s)(?![^\s|,·•])" % "|".join(re.escape(x) for x in sorted(MENU_LABELS, key=len, reverse=True)),
    re.IGNORECASE,
)
_NOTICE = re.compile("|".join(map(re.escape, NOTICE_WORDS)), re.IGNORECASE)
#: A notice's sentence reaches so many words before and after its phrase at most, and so many characters within a run without blanks.
NOTICE_BEFORE, NOTICE_AFTER, NOTICE_RUN = 10, 20, 24
_EMPTIED = re.compile(r"(?:\s*[|,·•]\s*){2,}")
_LABELS = tuple(MENU_LABELS)
_CODES = {code: 1 << i for i, code in enumerate(FUNCTION_WORDS)}
_MASK: dict[str, int] = {}
for _code, _words in FUNCTION_WORDS.items():
    for _w in _words:
        _MASK[_w] = _MASK.get(_w, 0) | _CODES[_code]

_READ_AS = ("cp1252", "cp1251", "cp1250", "iso8859-2", "koi8-r", "latin-1")
_WRITTEN_AS = ("cp1251", "cp1250", "iso8859-2", "koi8-r", "euc_jp", "shift_jis", "cp1252")

FEATURES = ("loose", "unbound", "focus", "repetition", "links", "tags", "hidden")


def _strange(text: str) -> int:
    """Characters outside ASCII."""
    return len(text) - len(text.encode("ascii", "ignore"))


def mend(text: str) -> str:
    """Undo one wrong decoding of UTF-8. Text that was read rightly is no valid UTF-8 when turned back into bytes."""
    if text.isascii():
        return text
    strange, asked, found = _strange(text), text.count("?"), []
    for charset in _READ_AS:
        raw = text.encode(charset, "replace")
        failed = raw.count(b"?") - asked
        if failed * 5 > strange:
            continue
        fixed = raw.decode("utf-8", "replace")
        failed += fixed.count("\ufffd")
        if failed * 5 <= strange and _strange(fixed) < 0.75 * strange:
            found.append(fixed.replace("\ufffd", ""))
    if len(set(found)) > 1:  # related charsets can both succeed; the right one gives the more known words
        return max(found, key=_bound_share)
    return found[0] if found else text


def _mend_charset(text: str) -> str:
    """Undo one wrong choice between single-byte or Japanese charsets, judged by function words and kana."""
    best, most = text, 2 * _bound_share(text) + 0.05
    for read in _READ_AS:
        raw = text.encode(read, "replace")
        for written in _WRITTEN_AS:
            if written != read:
                mended = raw.decode(written, "ignore")
                share = _bound_share(mended)
                if share > most:
                    best, most = mended, share
    return best


def known_language(text: str) -> str | None:
    """The language whose function words the text has most of, Japanese where a quarter is kana or Han; None without any."""
    if not text.isascii() and len(_CJK.findall(text)) * 4 > len(text):
        return "ja"
    masks = Counter(map(_MASK.get, _WORD.findall(text.lower())))
    hits = {code: sum(k for mask, k in masks.items() if mask and mask & bit) for code, bit in _CODES.items()}
    best = max(hits, key=hits.get)
    return best if hits[best] else None


def _bound_share(text: str) -> float:
    """Share of the words that are function words of the language that has most; 1 for text of which a quarter is kana."""
    words = _WORD.findall(text.lower())
    if len(_KANA.findall(text)) * 4 > len(text):
        return 1.0
    masks = Counter(map(_MASK.get, words))
    return max(sum(k for mask, k in masks.items() if mask and mask & bit) for bit in _CODES.values()) / max(1, len(words))


def _notice_start(piece: str, at: int) -> int:
    """Where the sentence begins whose notice phrase is at ``at``: the farthest capital of the few words before it."""
    base = max(0, at - 40 * NOTICE_BEFORE)
    words = list(re.finditer(r"\S+", piece[base:at]))[-NOTICE_BEFORE:]
    if words and base + words[-1].end() == at:  # the phrase stands within a word
        start = max(base + words.pop().start(), at - NOTICE_RUN)
    else:
        start = at
    for m in reversed(words):
        word = m.group()
        if "http" in word or word[0] in "|#·•/>»–-;" or word[-1] in "|·•;":
            break
        if word[0].isupper():
            start = base + m.start()
    return start


def _without_notices(piece: str) -> str:
    """The piece without the notices at its start and end; what stands in one line with them is kept."""
    for _ in range(3):
        found = list(_NOTICE.finditer(piece))
        if not found:
            break
        last, first = found[-1], found[0]
        if len(rest := piece[last.end() :].split()) <= NOTICE_AFTER and sum(map(len, rest)) <= 12 * NOTICE_AFTER:
            piece = piece[: _notice_start(piece, last.start())].strip(" |,·•\t")
        elif len(piece[: first.start()].split()) <= NOTICE_BEFORE and first.start() <= 12 * NOTICE_BEFORE:
            piece = re.sub(r"^[^\s|,·•]+", "", piece[first.end() :]).strip(" |,·•\t")
        else:
            break
    return piece


def content_sentences(text: str) -> list[str]:
    """The page's own sentences and lines: without menus, notices and footers."""
    out = []
    for piece in _SENTENCE.split(text):
        piece = piece.strip()
        low = piece.lower()
        noticed = any(w in low for w in NOTICE_WORDS)
        if noticed:
            piece = _without_notices(piece)
            low = piece.lower()
        if len(piece) < 1 + 2 * noticed or low in MENU_LABELS:
            continue
        if noticed or low.startswith(_LABELS) or piece.count("|") + piece.count(",") >= 4:
            labels = _MENU.findall(piece)
            if len(labels) >= 3 or (len(labels) == 2 and len(piece) < 60):
                piece = _EMPTIED.sub(" ", _MENU.sub(" ", piece)).strip(" |,·•\t")
                if len(piece) < 3:
                    continue
        out.append(piece)
    return out


def _words(piece: str, japanese: bool) -> list[str]:
    words = _WORD.findall(piece.lower())
    if japanese and _CJK.search(piece):
        return [x for w in words for x in (_SCRIPT_RUN.findall(w) if _CJK.match(w) else (w,))]
    return words


def features(text: str | None) -> tuple[str, int, tuple[float, ...]]:
    """Language by function words and script, words of own content, and the values of FEATURES (larger is spammier).

    loose: share of the words outside sentences and readable data; unbound: lack of function words outside sentences; focus: share of the
    two commonest content words; repetition: repeated content words; links, tags: links and hash tags a word; hidden:
    share of the words in disguised spelling (spread letters, zero-width breaks, digits for letters).
    """
    if not text:
        return "none", 0, (0.0,) * len(FEATURES)
    plain = mend(html.unescape(text) if "&" in text else text)
    language, total, values, lacking = _measured(plain)
    if total >= 8 and lacking > 0.3 and _strange(plain) * 33 > len(plain):
        mended = _mend_charset(plain)
        if mended is not plain:
            return _measured(mended)[:3]
    return language, total, values


def _measured(plain: str) -> tuple[str, int, tuple[float, ...], float]:
    """What ``features`` gives, and the lack of function words over the whole page."""
    zero = len(_ZERO_WIDTH.findall(plain))
    plain = _ZERO_WIDTH.sub("", plain) if zero else plain
    plain = plain if plain.isascii() else unicodedata.normalize("NFKC", plain)
    spread = sum(len(m) // 2 for m in _SPACED.findall(plain))
    lost = plain.count("\ufffd") * 5 > len(plain)
    if lost:  # letters beyond repair; the shape of words and sentences is all there is
        plain = plain.replace("\ufffd", _LOST)
    pieces = content_sentences(plain)
    japanese = len(_CJK.findall(plain)) * 5 > len(plain)
    links = tags = 0
    lines: list[tuple[str, list[str], int]] = []
    by_code = Counter()
    for piece in pieces:
        if "http" in piece or ".example" in piece or "www." in piece:
            piece, n_links = _LINK.subn(" ", piece)
            links += n_links
        tags += piece.count("#")
        words = _words(piece, japanese)
        if words:
            lines.append((piece, words, len(_SEPARATOR.findall(piece))))
            by_code.update([_MASK[w] for w in words if w in _MASK])
    hits = {code: sum(k for mask, k in by_code.items() if mask & bit) for code, bit in _CODES.items()}
    language = "ja" if japanese else max(hits, key=hits.get) if any(hits.values()) else "none"
    known = FUNCTION_WORDS.get(language, frozenset())
    content: Counter[str] = Counter()
    total = bound = data = prose = 0
    for piece, words, separators in lines:
        n = len(words)
        total += n
        numbers = len([w for w in words if w[0] in _DIGITS])
        if (numbers * 2 >= n and numbers > 1) or (numbers * 4 >= n and n > 2 and (":" in piece or (words[0][0] in _DIGITS and len(words[1]) <= 2))):
            data += n
            continue
        if japanese:
            f = 0
            for w in words:
                if "\u3040" <= w[0] <= "\u309f" and _PARTICLE.fullmatch(w):
                    f += 1
                elif w[0] not in _DIGITS:
                    content[w] += 1
            prose += n if f * 6 >= n and separators * 5 <= n and (piece.endswith(_ENDS) or (f * 4 >= n and not separators)) else 0
        else:
            f = 0
            for w in words:
                if w in known or (lost and len(w) <= 3 and not w.strip(_LOST)):
                    f += 1
                elif lost and w[0] == _LOST:
                    continue
                elif len(w) > 1 and w[0] not in _DIGITS and w not in NEUTRAL_WORDS:
                    content[w] += 1
            ended = piece.rstrip(" \"'»”)").endswith(_ENDS)
            if n >= 5 and separators * 5 <= n and ((ended and (f or len(set(words)) == n)) or f * 5 >= n and n >= 8):
                prose += n
            elif ended and n >= 3 and f * 4 >= n and not separators:
                prose += n
        bound += f
    if not total:
        return language, 0, (0.0,) * len(FEATURES), 0.0
    said = max(1, total - data)
    n_content = sum(content.values())
    top = sum(k for _, k in content.most_common(2)) - 4  # two words used twice are nothing on a short page
    focus = max(0, top) / max(1, n_content)
    repetition = (n_content - len(content)) / max(1, n_content)
    odd = len(_LEET.findall(plain)) if "$" in plain or "@" in plain else 0
    hidden = min(1.0, (spread + zero / 3 + odd) / total)
    lacking = 1.0 - min(1.0, bound / said / 0.2) if data * 2 < total else 0.0
    loose = 1.0 - (prose + data) / total
    unbound = lacking * min(1.0, 2.0 * loose)  # sentences of languages with few function words are no lists
    return language, total, (loose, unbound, focus, repetition, min(1.0, links / said), min(1.0, tags / said), hidden), lacking


def feature_array(texts) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, word counts and the feature matrix of many texts."""
    rows = [features(t if isinstance(t, str) else None) for t in texts]
    return [r[0] for r in rows], np.array([r[1] for r in rows], dtype="int64"), np.array([r[2] for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
