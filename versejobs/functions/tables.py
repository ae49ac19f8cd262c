"""Fixed values of the phonetic model, and the integer codes that the expressions use.

A syllable is an integer: 32 * (index of its vowel) + (index of its coda, 0 for none).
"""

# Hangul letters in the order of their code points within a syllable.
ONSETS = ["ㄱ", "ㄲ", "ㄴ", "ㄷ", "ㄸ", "ㄹ", "ㅁ", "ㅂ", "ㅃ", "ㅅ", "ㅆ", "ㅇ", "ㅈ", "ㅉ", "ㅊ", "ㅋ", "ㅌ", "ㅍ", "ㅎ"]
VOWELS = ["ㅏ", "ㅐ", "ㅑ", "ㅒ", "ㅓ", "ㅔ", "ㅕ", "ㅖ", "ㅗ", "ㅘ", "ㅙ", "ㅚ", "ㅛ", "ㅜ", "ㅝ", "ㅞ", "ㅟ", "ㅠ", "ㅡ", "ㅢ", "ㅣ"]
CODAS = [None, "ㄱ", "ㄲ", "ㄳ", "ㄴ", "ㄵ", "ㄶ", "ㄷ", "ㄹ", "ㄺ", "ㄻ", "ㄼ", "ㄽ", "ㄾ", "ㄿ", "ㅀ", "ㅁ", "ㅂ", "ㅄ", "ㅅ", "ㅆ", "ㅇ", "ㅈ", "ㅊ", "ㅋ", "ㅌ", "ㅍ", "ㅎ"]

# The vowel that each vowel resembles (read from the first of two syllables), and groups of alike codas.
SIMILAR_VOWEL = {"ㅐ": "ㅔ", "ㅔ": "ㅐ", "ㅖ": "ㅔ", "ㅒ": "ㅐ", "ㅗ": "ㅜ", "ㅜ": "ㅗ", "ㅡ": "ㅣ", "ㅣ": "ㅡ", "ㅏ": "ㅑ", "ㅑ": "ㅏ", "ㅓ": "ㅕ", "ㅕ": "ㅓ", "ㅙ": "ㅐ", "ㅚ": "ㅔ", "ㅞ": "ㅔ"}
CODA_GROUPS = (["ㄴ", "ㅁ", "ㅇ"], ["ㄱ", "ㅂ", "ㄷ", "ㅅ", "ㅋ", "ㅌ", "ㅍ"], ["ㄹ"])

# ARPAbet vowels, and consonants as simple coda, as onset and as loanword coda.
PHONE_VOWEL = {"AA": "ㅏ", "AE": "ㅐ", "AH": "ㅓ", "AO": "ㅗ", "AW": "ㅏ", "AY": "ㅏ", "EH": "ㅔ", "ER": "ㅓ", "EY": "ㅔ", "IH": "ㅣ", "IY": "ㅣ", "OW": "ㅗ", "OY": "ㅗ", "UH": "ㅜ", "UW": "ㅜ"}
PHONE_CODA = {
    "B": "ㅂ", "P": "ㅂ", "F": "ㅂ", "V": "ㅂ", "D": "ㄷ", "T": "ㄷ", "TH": "ㄷ", "DH": "ㄷ", "G": "ㄱ", "K": "ㄱ", "M": "ㅁ", "N": "ㄴ",
    "NG": "ㅇ", "L": "ㄹ", "R": "ㄹ", "S": "ㅅ", "Z": "ㅅ", "SH": "ㅅ", "ZH": "ㅅ", "CH": "ㅅ", "JH": "ㅅ",
}
PHONE_ONSET = {
    "B": "ㅂ", "P": "ㅍ", "F": "ㅍ", "V": "ㅂ", "D": "ㄷ", "T": "ㅌ", "TH": "ㅌ", "DH": "ㄷ", "G": "ㄱ", "K": "ㅋ", "M": "ㅁ", "N": "ㄴ",
    "NG": "ㅇ", "L": "ㄹ", "R": "ㄹ", "S": "ㅅ", "Z": "ㅈ", "SH": "ㅅ", "ZH": "ㅈ", "CH": "ㅊ", "JH": "ㅈ", "HH": "ㅎ", "W": "ㅇ", "Y": "ㅇ",
}
PHONE_LOAN_CODA = PHONE_CODA | {"CH": "ㅊ", "JH": "ㅈ"}
#: Consonants after which an added vowel is ㅣ; after all others it is ㅡ.
FRONT_PHONES = ("CH", "JH", "Y")

# Letters of words that no dictionary has.
LETTER_VOWEL = {"a": "ㅏ", "e": "ㅔ", "i": "ㅣ", "o": "ㅗ", "u": "ㅜ", "y": "ㅣ"}
LETTER_CODA = {"b": "ㅂ", "c": "ㄱ", "d": "ㄷ", "f": "ㅂ", "g": "ㄱ", "j": "ㅅ", "k": "ㄱ", "l": "ㄹ", "m": "ㅁ", "n": "ㄴ", "p": "ㅂ", "q": "ㄱ", "r": "ㄹ", "s": "ㅅ", "t": "ㄷ", "v": "ㅂ", "x": "ㄱ", "z": "ㅅ"}

# English words that bear no rhyme.
STOPWORDS = [
    "a", "ah", "an", "and", "are", "ay", "ayy", "em", "for", "ha", "hey", "huh", "in", "is", "mm", "of", "ooh",
    "oh", "on", "or", "the", "to", "uh", "with", "whoa", "whoo", "woah", "woo", "ya", "yah", "yea", "yeah", "yo", "yuh",
]

# English words with a given Hangul spelling; the second list wins.
BUILT_IN = {"apple": "애플", "orange": "오렌지", "party": "파티", "money": "머니", "vibe": "바이브", "radio": "라디오", "cookie": "쿠키"}
MANUAL = {
    "again": "어게인", "all": "올", "am": "앰", "and": "앤", "away": "어웨이", "baby": "베이비", "babe": "베이브", "back": "백",
    "bad": "배드", "bag": "백", "beat": "비트", "be": "비", "bitch": "비치", "boy": "보이", "but": "벗", "care": "케어",
    "city": "시티", "club": "클럽", "cool": "쿨", "dance": "댄스", "damn": "댐", "daddy": "대디", "day": "데이", "do": "두",
    "down": "다운", "em": "엠", "face": "페이스", "fan": "팬", "feel": "필", "flex": "플렉스", "flow": "플로우", "fuck": "퍽",
    "game": "게임", "gang": "갱", "girl": "걸", "go": "고", "god": "갓", "good": "굿", "head": "헤드", "here": "히어",
    "high": "하이", "home": "홈", "hop": "합", "i": "아이", "in": "인", "it": "잇", "know": "노우", "life": "라이프",
    "like": "라이크", "love": "러브", "low": "로우", "man": "맨", "me": "미", "mic": "마이크", "mind": "마인드", "money": "머니",
    "more": "모어", "motherfucker": "마더퍼커", "name": "네임", "night": "나잇", "no": "노", "nobody": "노바디", "now": "나우", "off": "오프",
    "oh": "오", "okay": "오케이", "on": "온", "one": "원", "out": "아웃", "party": "파티", "rap": "랩", "rapper": "래퍼",
    "real": "리얼", "rhyme": "라임", "right": "라잇", "run": "런", "say": "세이", "shit": "쉿", "so": "소", "star": "스타",
    "stop": "스탑", "style": "스타일", "talk": "톡", "team": "팀", "that": "댓", "thing": "띵", "this": "디스", "time": "타임",
    "to": "투", "top": "탑", "too": "투", "track": "트랙", "tv": "티비", "up": "업", "vibe": "바이브", "want": "원트",
    "way": "웨이", "what": "왓", "world": "월드", "wow": "와우", "you": "유",
}
OVERRIDES = BUILT_IN | MANUAL

FIRST_HANGUL, LAST_HANGUL = 0xAC00, 0xD7A3


def code(vowel: str, coda: str | None) -> int:
    return 32 * VOWELS.index(vowel) + CODAS.index(coda)


def hangul_codes(text: str) -> list[int]:
    """Syllable codes of the Hangul characters in a text."""
    places = [ord(ch) - FIRST_HANGUL for ch in text if FIRST_HANGUL <= ord(ch) <= LAST_HANGUL]
    return [32 * (n % 588 // 28) + n % 28 for n in places]


#: By vowel index, the index of the similar vowel or -1; by coda index, the group's number, 0 for none.
SIMILAR = [VOWELS.index(SIMILAR_VOWEL[v]) if v in SIMILAR_VOWEL else -1 for v in VOWELS]
GROUP = [next((k for k, g in enumerate(CODA_GROUPS, 1) if c in g), 0) for c in CODAS]
OVERRIDE_CODES = {w: hangul_codes(h) for w, h in OVERRIDES.items()}
