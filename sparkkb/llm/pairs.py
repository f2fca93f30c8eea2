"""Defective question and answer pairs, by tagging the clauses of the answer.

A conditional random field tags each clause as answer, refusal, echo of the question, foreign
language, unfinished, courtesy or nothing (labels and placeholders). It is trained on at most TRAIN_ROWS pairs
chosen by hash: their clauses as they are, with seed tags where a cue is certain, and the same pairs made defective:
answers cut, put below a question in another language, replaced by the question or by a placeholder.
The tags' coverage gives the defect of a pair; an answer of which nothing is covered is empty.

Clauses, features and tags of a whole Arrow batch are worked out at once, over flat arrays of its code points.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkkb.llm import codepoints, truncation
from sparkkb.llm.codepoints import END, LETTER, NUMBER, SPACE, mix

#: Bound of the training sample, in pairs, and pairs of it that a task makes examples of.
TRAIN_ROWS, TASK_ROWS = 4_000, 500
WIDTH_BITS = 16
WIDTH = 1 << WIDTH_BITS
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED, COURTESY, NOTHING = range(7)
TAGS = 7
TEXT, LIST, TABLE, CODE = range(4)
#: Conjunctions that begin a clause of their own after a comma; a Chinese comma always ends one.
CONJUNCTIONS = "but so though although however yet aber doch jedoch sodass mais donc pourtant cependant pero aunque sino".split()
#: Frequent function words of the languages of the questions.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it as was with be by on not this are or from at which but have an had its has been were if will would can does what how when where why who after before while until although because since so every only".split(),
    "de": "der die das und ist von den dem des ein eine einen einem einer nicht mit auf für im zu sich auch als bei nach wird wurde wie was wann wo warum wer welche welcher hat haben wenn weil obwohl damit bis seit jeden jede ohne noch aber sodass solange vom zum zur in an ihr ihren ihrer ihre sie es wir ich kann muss über unter vor nur ob".split(),
    "fr": "le la les de des du un une et est que qui dans pour pas sur avec sont au aux par ce cette il elle ne se plus comme où quand pourquoi quel quelle après avant pendant jusqu toute tout toutes sans mais afin depuis chaque ont été sa son ses à nous vous je ils elles leur leurs aussi lorsque entre puis".split(),
    "es": "el la los las de del un una y es que en para no con por se su sus al lo como más pero fue son cuando dónde cómo cuántas quién qué cuál tras hasta aunque porque desde cada sin cualquier solo mientras después antes nadie está ya muy sobre entre hay ser".split(),
}
#: Names of languages in these languages.
LANGUAGE_NAMES = {
    "en": "english|englisch|anglais|ingl[eé]s|英文|英语|英語", "de": "german|deutsch|allemand|alem[aá]n|德文|德语|德語", "fr": "french|franz[oö]sisch|fran[cç]ais|franc[eé]s|法文|法语|法語",
    "es": "spanish|spanisch|espagnol|español|castellano|西班牙文|西班牙语|西班牙語", "zh": "chinese|chinesisch|chinois|chino|中文|汉语|漢語",
}
_REQUEST = r"(?i)answer|reply|respond|write|antwort|schreib|répon|repond|respond|respuesta|contest|escrib|por favor|please|bitte|merci|用|请"
#: Words that stand for no value, and labels that introduce an answer.
PLACEHOLDERS = tuple("null none nil nan na n/a undefined empty void tbd todo keine aucun ninguno ninguna 无 暂无 空 placeholder missing".split())
_LABELS = re.compile(r"(?i)\b(?:answer|final answer|response|reply|antwort|réponse|reponse|respuesta|output|result|text|content|答案|回答)\b\s*[:：=]?|(?:答案|回答)\s*[:：]")
_MARKUP = re.compile(r"</?[A-Za-z][\w-]*(?:\s[^<>]*)?/?>|&nbsp;|```\w*")
_PLACEHOLDER = re.compile(r"(?is)\W*(?:(?:\"\w+\"|\w+)\s*:\s*)?\"?(?:" + "|".join(map(re.escape, PLACEHOLDERS)) + r")\"?\W*")
#: Seeds of refusals: a clause that denies, and speaks of answering, knowing or the sources. By language, general words only.
_DENIES = re.compile(
    r"(?i)\b(?:not|no|none|nothing|cannot|unable|insufficient|neither|decline|silent|outside|against|pass|unfortunately)\b|n['’]t\b"
    r"|\b(?:nicht|nichts|kein\w*|leider)\b|\b(?:ne|pas|aucune?|rien|impossible)\b|\bn['’]|\b(?:no|nada|ningun[oa]?|ningún|imposible)\b|不|无|没|未")
_OF_ANSWERS = re.compile(
    r"(?i)\b(?:answer\w*|know|say|tell|help\w*|assist|able|details|comment|speculate|information|data|evidence|mention\w*|context|sources?|documents|passages|pages|material|retrieved|found|find|determined|question|reply|decline|policy|pass|appropriate)\b"
    r"|\b(?:\w*antwort\w*|weiß|sagen|auskunft|information\w*|helfen|hilft|quellen|dokument\w*|unterlagen|kontext|frage|gefunden|äußern|stellen)\b"
    r"|\b(?:répon\w*|sais|dire|disent|informations?|sources|documents|passages|contexte|question|aider|conclure|trouvée?s?|suite)\b"
    r"|\b(?:respond\w*|respuesta|contestar|sé|decir|dicen|información|fuentes|documentos|pasajes|contexto|pregunta|ayudar|encontrado)\b|回答|作答|知道|提到|信息|资料|答案|确定|判断|透露|评论|没有说明|相关|内容")
#: Seeds of courtesies: thanks, regrets, offers and advice, and the first person telling of its search.
_COURTESIES = re.compile(
    r"(?i)^\W*(?:hmm+|well|sure|of course|certainly|thank\w*|(?:i['’]m |i am |so )?sorry|my apologies|es tut mir leid|tut mir leid|entschuldigung|(?:je suis )?désolée?|lo siento|lamento|抱歉|please|try|contact|is there anything|let me know|i (?:have )?(?:checked|searched|looked|reviewed)|danke|bitte|fragen sie|wenden sie|versuchen|ich habe .*(?:geprüft|gesucht|durchsucht)"
    r"|merci\b(?! de)|essayez|adressez|veuillez|j['’]ai (?:vérifié|consulté|cherché)|gracias|pruebe|consulte|dir[ií]jase|he (?:revisado|buscado|consultado)|谢谢|好的|请|可以改问|我(?:查|搜|看)了)")
_TOKENS = re.compile(r"[一-鿿]{1,2}|[^\W_一-鿿]+")


def is_empty(answer: str | None) -> bool:
    """Nothing said: null, blank, invisible, punctuation only, an empty wrapper or a placeholder for no value."""
    if answer is None:
        return True
    text = _LABELS.sub(" ", _MARKUP.sub(" ", answer))
    if answer.strip().strip("\"'`*_.-<>[]{}() ").lower() in PLACEHOLDERS:
        return True
    return not any(unicodedata.category(c) in ("Sc", "So") or unicodedata.category(c)[0] in "LN" for c in text) or bool(_PLACEHOLDER.fullmatch(text))


def _among(points: np.ndarray, chars: str) -> np.ndarray:
    return np.isin(points, np.array([ord(c) for c in chars], points.dtype))


def _shift(x: np.ndarray, k: int) -> np.ndarray:
    """x[i - k] at i, zero where there is none."""
    out = np.zeros_like(x)
    out[k:] = x[: len(x) - k]
    return out


def _next(where: np.ndarray) -> np.ndarray:
    """The first index from each on where it holds, else the length."""
    n = len(where)
    return np.minimum.accumulate(np.where(where, np.arange(n), n)[::-1])[::-1] if n else np.empty(0, np.int64)


def _last(where: np.ndarray) -> np.ndarray:
    """The last index up to each where it holds, else -1."""
    return np.maximum.accumulate(np.where(where, np.arange(len(where)), -1)) if len(where) else np.empty(0, np.int64)


class Words:
    """Words of a batch of texts: lower-cased hashes (digits alike), and where each begins."""

    def __init__(self, points: np.ndarray):
        self.kind = codepoints.classes()[points]
        self.alnum = (self.kind == LETTER) | (self.kind == NUMBER)
        han = (points >= codepoints.HAN_FIRST) & (points <= codepoints.HAN_LAST)
        self.han = han
        self.begin = np.flatnonzero(self.alnum & (~_shift(self.alnum, 1) | han | _shift(han, 1)))
        keys = codepoints.lower_keys()[np.where(self.kind == NUMBER, 0x39, points)[self.alnum]]
        self.hashes = codepoints.span_hashes(keys, np.cumsum(self.alnum)[self.begin] - 1)


@lru_cache(maxsize=1)
def _function_words() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of function words, and the languages that have each as bits."""
    of: dict[int, int] = {}
    for bit, words in enumerate(FUNCTION_WORDS.values()):
        for h in Words(codepoints.flat(pa.array(words))[0]).hashes.tolist():
            of[h] = of.get(h, 0) | 1 << bit
    hashes = np.array(sorted(of), np.uint64)
    return hashes, np.array([of[h] for h in hashes.tolist()], np.int64)


@lru_cache(maxsize=1)
def _conjunctions() -> np.ndarray:
    return Words(codepoints.flat(pa.array(CONJUNCTIONS))[0]).hashes


LANGUAGES = (*FUNCTION_WORDS, "zh")


def _spoken(words: Words, group: np.ndarray, of_char: np.ndarray, n: int) -> np.ndarray:
    """Function words of each language by group (of words, and of characters); half the Han characters for Chinese."""
    known, bits = _function_words()
    at = np.minimum(np.searchsorted(known, words.hashes), len(known) - 1)
    mask = np.where(known[at] == words.hashes, bits[at], 0)
    out = np.zeros((n, len(LANGUAGES)))
    for k in range(len(FUNCTION_WORDS)):
        out[:, k] = np.bincount(group[(mask >> k & 1) == 1], minlength=n)
    han = np.bincount(of_char[words.han & (of_char >= 0)], minlength=n)
    out[:, -1] = np.where(han >= 4, han / 2, 0)
    return out


def _tongue(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language with the most words, -1 without any, and its lead on the next one."""
    if not len(found):
        return np.empty(0, np.int64), np.empty(0)
    two = np.sort(found, axis=1)[:, -2:]
    lead = two[:, 1] - two[:, 0]
    return np.where(lead > 0, found.argmax(1), -1), lead


def _wanted(questions: pa.Array, own: np.ndarray) -> np.ndarray:
    """Languages as bits: the question's, and those that it asks for."""
    out = np.where(own >= 0, 1 << np.maximum(own, 0), 0)
    says = lambda pattern: pc.fill_null(pc.match_substring_regex(questions, pattern), False).to_numpy(zero_copy_only=False)
    asks = says(_REQUEST)
    for k, language_ in enumerate(LANGUAGES):
        out |= np.where(asks & says("(?i)" + LANGUAGE_NAMES[language_]), 1 << k, 0)
    return out


def languages(texts: list[str]) -> list[tuple[str, float]]:
    """The language of each text by its function words or script, and how many more of them it has than of the next one; ('', 0) without any."""
    points, starts = codepoints.flat(pa.array(texts, pa.string()))
    words = Words(points)
    of = np.repeat(np.arange(len(texts)), np.diff(starts))
    return [(LANGUAGES[t], float(x)) if t >= 0 else ("", 0) for t, x in zip(*_tongue(_spoken(words, of[words.begin], of, len(texts))), strict=True)]


def language(text: str) -> tuple[str, float]:
    return languages([text])[0]


def allowed_languages(question: str) -> set[str]:
    """The question's language, and one that it asks for."""
    own = language(question)[0]
    bits = int(_wanted(pa.array([question]), np.array([LANGUAGES.index(own) if own else -1]))[0])
    return {x for k, x in enumerate(LANGUAGES) if bits >> k & 1}


def _trigrams(points: np.ndarray, alnum: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of three letters or digits, whatever is between them, and the group of each."""
    at = np.flatnonzero(alnum & (group >= 0))
    k, g = codepoints.lower_keys()[points[at]], group[at]
    whole = g[:-2] == g[2:]
    return mix(mix(k[:-2] + np.uint64(3)) + k[1:-1] * np.uint64(0x9E3779B97F4A7C15) + k[2:])[whole] if len(at) > 2 else np.empty(0, np.uint64), g[:-2][whole] if len(at) > 2 else np.empty(0, np.int64)


class Pairs:
    """A batch of pairs: the clauses of the answers as flat arrays, and the feature slots of each clause."""

    def __init__(self, questions: pa.Array, answers: pa.Array):
        questions, answers = questions.cast(pa.string()), answers.cast(pa.string())
        self.points, starts = codepoints.flat(answers)
        self.n = len(starts) - 1
        self._cut(starts)
        self._features(questions, starts)

    def _cut(self, starts: np.ndarray) -> None:
        """Clauses: sentences and parts after a colon or semicolon; a table or a code block is one. Clauses without a letter or digit are none."""
        points, n = self.points, len(self.points)
        self.words = words = Words(points)
        text = np.repeat(np.arange(self.n), np.diff(starts))
        space = (words.kind == SPACE) | (words.kind == END)
        new_line = _shift(_among(points, "\n\r\v\f\x85\u2028\u2029"), 1)
        new_line[starts[:-1]] = True
        line = np.cumsum(new_line) - 1
        first = np.flatnonzero(new_line)
        lines = len(first)
        end = np.append(first[1:], n)
        at = np.minimum(_next(~space)[first], end - 1) if n else first
        pad = np.concatenate([points, np.full(3, codepoints.SENTINEL, points.dtype)])
        c = pad[at]
        fence = _among(c, "`~") & (pad[at + 1] == c) & (pad[at + 2] == c)
        so_far = np.cumsum(fence)
        of_text = text[first]
        text_first = np.searchsorted(of_text, np.arange(self.n))
        before = so_far - fence - (so_far - fence)[text_first][of_text]
        code = fence | (before % 2 == 1)
        table = ~code & (c == 0x7C)
        digits = np.minimum(_next(words.kind != NUMBER)[at], n - 1) if n else at
        number = (words.kind[at] == NUMBER) & _among(pad[digits], ".)") & space[np.minimum(digits + 1, n - 1)] if n else np.zeros(0, bool)
        item = ~code & ~table & ((_among(c, "-*•+") & space[np.minimum(at + 1, n - 1)]) | number) if n else np.zeros(0, bool)
        joins = (code & ~(fence & (before % 2 == 0))) | (table & _shift(table, 1) & (of_text == _shift(of_text, 1)))
        begins = new_line.copy()
        begins[first[joins]] = False
        ends = _among(points, ".!?…;:")
        ends[digits[item & number]] = False
        closing = _among(points, "\"')]*”’»")
        over = space & (_shift(ends, 1) | (_shift(closing, 1) & (_shift(ends, 2) | (_shift(closing, 2) & _shift(ends, 3)))))
        begins |= _shift(over | _among(points, "。！？；：，"), 1) & ~(code | table)[line] & (words.kind != END)
        after = words.begin[np.isin(words.hashes, _conjunctions()) & (_shift(points, 2) == 0x2C)[words.begin] & (_shift(points, 1) == 0x20)[words.begin]] if n else words.begin
        begins[after[~(code | table)[line[after]]]] = True
        cid = np.cumsum(begins) - 1
        first_of = np.flatnonzero(begins)
        held = np.add.reduceat(words.alnum, first_of) > 0 if len(first_of) else np.zeros(0, bool)
        compact = np.where(held, np.cumsum(held) - 1, -1)
        self.clause = compact[cid] if n else np.empty(0, np.int64)
        self.begin = first_of[held]
        self.end = np.append(first_of[1:], n)[held]
        self.text = text[self.begin]
        self.m = len(self.begin)
        of_line = line[self.begin]
        self.kind = np.where(code[of_line], CODE, np.where(table[of_line], TABLE, np.where(item[of_line], LIST, TEXT)))
        self.size = np.bincount(self.text, minlength=self.n)
        self.first = np.cumsum(self.size) - self.size
        self.length = np.bincount(self.clause[(self.clause >= 0) & ~space], minlength=self.m)
        visible = _last(~space)
        self.closes = visible[self.end - 1]  # the last visible character of each clause
        self.tail = visible[starts[1:] - 1]  # and of each text
        open_code = np.bincount(of_text[fence], minlength=self.n) % 2 == 1
        pipes = np.bincount(line[points == 0x7C], minlength=lines)
        last_line = np.maximum(line[np.maximum(self.tail, 0)], 0) if n else np.zeros(self.n, np.int64)
        above = np.maximum(last_line - 1, 0)
        fewer = np.where((last_line > text_first) & table[above] & table[last_line], np.sign(pipes[last_line] - pipes[above]), 2) if lines else np.zeros(self.n, np.int64)
        self.line_end = [open_code, fewer, np.where(fence[last_line], 4, np.where(code[last_line], CODE, np.where(table[last_line], TABLE, np.where(item[last_line], LIST, TEXT)))) if lines else np.zeros(self.n, np.int64)]

    def _features(self, questions: pa.Array, starts: np.ndarray) -> None:
        points, words, m, text, kind = self.points, self.words, self.m, self.text, self.kind
        of_word = self.clause[words.begin] if len(points) else np.empty(0, np.int64)
        count = np.bincount(of_word, minlength=m)
        # languages
        asked, asked_starts = codepoints.flat(questions)
        asked_words = Words(asked)
        row = np.repeat(np.arange(self.n), np.diff(asked_starts))
        own, _ = _tongue(_spoken(asked_words, row[asked_words.begin], row, self.n))
        wanted = _wanted(questions, own)
        spoken = _spoken(words, of_word, self.clause, m)
        spoken[kind >= TABLE] = 0
        tongue, lead = _tongue(spoken)
        self.foreign = np.where((tongue >= 0) & (wanted[text] != 0) & (wanted[text] >> np.maximum(tongue, 0) & 1 == 0), lead, 0)
        whole, _ = _tongue(np.add.reduceat(np.vstack([spoken, np.zeros(len(LANGUAGES))]), np.minimum(self.first, m)) * (self.size > 0)[:, None] if self.n else np.zeros((0, len(LANGUAGES))))
        elsewhere = (whole >= 0) & (wanted != 0) & (wanted >> np.maximum(whole, 0) & 1 == 0)
        # echo: trigrams of the clause that the question has, as often
        grams, of = _trigrams(points, words.alnum, self.clause)
        q_grams, q_of = _trigrams(asked, asked_words.alnum, row)
        salt = np.uint64(0xA24BAED4963EE407)
        keys, times = np.unique(mix(q_grams + q_of.astype(np.uint64) * salt), return_counts=True)
        _, at, mine = np.unique(mix(grams + of.astype(np.uint64) * salt + np.uint64(1)), return_index=True, return_counts=True)
        look = mix(grams[at] + text[of[at]].astype(np.uint64) * salt)
        found = np.minimum(np.searchsorted(keys, look), max(0, len(keys) - 1))
        shared = np.where(keys[found] == look, np.minimum(mine, times[found]), 0) if len(keys) else np.zeros(len(look), np.int64)
        both = np.bincount(of[at], shared, m)
        back = both / np.maximum(1, np.bincount(of, minlength=m))
        asked_size = np.maximum(1, np.bincount(q_of, minlength=self.n))
        ahead = both / asked_size[text]
        near = np.bincount(text[back > 0.8], both[back > 0.8], self.n) / asked_size
        self.echo = np.where(back > 0.8, np.minimum(back, near[text]), 0)
        position = (np.arange(m) == self.first[text]) + 2 * (np.arange(m) == (self.first + self.size - 1)[text])
        last_char = points[self.closes].astype(np.uint64) if m else np.empty(0, np.uint64)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        every = np.arange(m)

        def add(clause: np.ndarray, *parts: np.ndarray | int | str) -> None:
            h = np.full(len(clause), zlib.crc32(str(len(out)).encode()), np.uint64)
            for p in parts:
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.asarray(p).astype(np.uint64))
            out.append((clause, h >> np.uint64(64 - WIDTH_BITS)))

        add(every, 0)
        add(every, kind)
        add(every, back * 10)
        add(every, ahead * 5)
        add(every, back > 0.85, near[text] * 5)
        add(every, self.foreign.clip(0, 3), kind)
        add(every, elsewhere[text], kind)
        add(every, elsewhere[text], self.foreign.clip(0, 3), tongue + 1)
        add(every, count.clip(0, 12))
        add(every, position, self.size[text] == 1)
        add(every, last_char)
        add(every, last_char, count.clip(0, 5), position)
        add(of_word, words.hashes)
        pair = np.flatnonzero(of_word[:-1] == of_word[1:])
        add(of_word[pair], words.hashes[pair], words.hashes[pair + 1])
        # how the answer ends
        some = np.flatnonzero(self.size > 0)
        end_of = self.first[some] + self.size[some] - 1
        tail = self.tail[some]
        alnum = words.alnum[tail] if len(points) else np.zeros(len(some), bool)
        end = np.where(~alnum, points[tail], np.where(words.han[tail], 2, np.where(words.kind[tail] == NUMBER, 1, 0))) if len(points) else np.zeros(0, np.int64)
        open_code, fewer, line_kind = (x[some] for x in self.line_end)
        upto = np.searchsorted(words.begin, tail, "right") - 1
        capital = codepoints.lower_case()[points[words.begin]] != points[words.begin] if len(points) else np.zeros(0, bool)
        shape = np.where(capital, np.uint64(1), words.hashes)
        word = lambda k: np.where((upto - k >= 0) & (of_word[np.maximum(upto - k, 0)] == end_of), shape[np.maximum(upto - k, 0)], np.uint64(0))
        one, two, three = word(0), word(1), word(2)
        size = (tail - words.begin[np.maximum(upto, 0)] + 1).clip(0, 12) if len(points) else np.zeros(0, np.int64)
        begin = np.searchsorted(of_word, end_of)
        at_begin = lambda k: np.where((begin + k < len(of_word)) & (of_word[np.minimum(begin + k, len(of_word) - 1)] == end_of), shape[np.minimum(begin + k, len(of_word) - 1)], np.uint64(0)) if len(of_word) else one
        head, second = at_begin(0), at_begin(1)
        n_words = np.bincount(text, count, self.n)[some]
        opened = np.zeros(m, np.int64)
        for a, b in ("()", "[]", "{}", "（）", "「」", "“”"):
            opened += np.bincount(self.clause[(points == ord(a)) & (self.clause >= 0)], minlength=m) > np.bincount(self.clause[(points == ord(b)) & (self.clause >= 0)], minlength=m)
        opened += np.bincount(self.clause[(points == 0x22) & (self.clause >= 0)], minlength=m) % 2
        lower = codepoints.lower_keys()[points]
        add(end_of, line_kind, end)
        add(end_of, line_kind, open_code, fewer + 1, end == 0x7C)
        add(end_of, line_kind, opened[end_of].clip(0, 2))
        add(end_of, n_words.clip(0, 8), self.size[some] == 1, alnum)
        add(end_of, n_words <= 5, self.size[some] == 1)
        add(end_of, line_kind, one)
        add(end_of, line_kind, one, two)
        add(end_of, line_kind, one, two, three)
        add(end_of, line_kind, head, second, one)
        add(end_of, line_kind, head, second, count[end_of].clip(0, 30) // 2)
        add(end_of, line_kind, count[end_of].clip(0, 30) // 3, alnum)
        add(end_of, line_kind, size, alnum)
        gram = np.zeros(len(some), np.uint64)
        for k in range(6):  # the last characters, which show cut words, and signs of a cut
            gram = mix(gram * np.uint64(0x9E3779B97F4A7C15) + np.where(tail - k >= starts[some], lower[np.maximum(tail - k, 0)], np.uint64(0)))
            if k:
                add(end_of, line_kind, gram, k)
        clause, slots = np.concatenate([c for c, _ in out]), np.concatenate([s for _, s in out]).astype(np.int32)
        order = np.argsort(clause, kind="stable")
        self.slots, self.edges = slots[order], np.searchsorted(clause[order], np.arange(m + 1))
        # a phrase of a few words is complete, whatever it ends in
        self.phrase = np.zeros(m, bool)
        self.phrase[end_of[(n_words <= 4) & (self.size[some] == 1) & (alnum | (end == 0x2A)) & (line_kind == TEXT)]] = True

    def clause_text(self, i: int) -> str:
        points = self.points[self.begin[i] : self.end[i]]
        return points[points != codepoints.SENTINEL].astype("<u4").tobytes().decode("utf-32-le")

    def emissions(self, w: np.ndarray) -> np.ndarray:
        if not self.m:
            return np.zeros((0, TAGS))
        out = np.add.reduceat(w[self.slots], self.edges[:-1], axis=0)
        out[self.phrase, UNFINISHED] -= 1e3
        return out

    def seeds(self) -> list[list[int]]:
        """Tags of each answer by certain cues, answer where there is none."""
        out: list[list[int]] = [[] for _ in range(self.n)]
        for i, (row, kind, echo, foreign) in enumerate(zip(self.text.tolist(), self.kind.tolist(), self.echo.tolist(), self.foreign.tolist(), strict=True)):
            said = self.clause_text(i).strip()
            if is_empty(said) or (kind == TEXT and said[-1:] in ":：" and len(_TOKENS.findall(said)) <= 4):
                tag = NOTHING
            elif echo > 0.8:
                tag = ECHO
            elif kind in (TEXT, LIST) and _DENIES.search(said) and _OF_ANSWERS.search(said):
                tag = REFUSAL
            elif kind == TEXT and _COURTESIES.match(said):
                tag = COURTESY
            else:
                tag = FOREIGN if foreign >= 2 else ANSWER
            out[row].append(tag)
        return out


def _examples(rows: list[tuple[int, str, str]]) -> tuple[list[tuple[int, str, str]], list[list[int] | None]]:
    """(line, question, answer) as they are and made defective, and the tags of each; None: no example."""
    plain = Pairs(pa.array([q for _, q, _ in rows], pa.string()), pa.array([a for *_, a in rows], pa.string())).seeds()
    by: dict[str, list[str]] = {}
    tongues = [t for t, _ in languages([q for _, q, _ in rows])]
    for (_, q, _), t in zip(rows, tongues, strict=True):
        by.setdefault(t, []).append(q)
    made: list[tuple[int, str, str]] = []
    how: list[tuple[str, list[int]]] = []
    for (line, question, answer), tags, own in zip(rows, plain, tongues, strict=True):
        if not tags:
            continue
        rng = random.Random(zlib.crc32(str(line).encode()))
        kind, last = truncation.last_line(answer.rstrip())
        shut = kind in ("list", "path", "sign", "fence") or kind == "table" and last.endswith("|") or kind != "code" and (last[-1:] in ".!?。！？*)]\"" or len(_TOKENS.findall(answer)) <= 5)
        made.append((line, question, answer))
        how.append(("as", tags if shut else [*tags[:-1], UNFINISHED] if tags[-1] in (ANSWER, FOREIGN) else tags))
        if len(answer) > 60 and shut and tags[-1] == ANSWER:
            for cut in (truncation._cut(answer, rng, []) for _ in range(3)):
                if cut:
                    made.append((line, question, cut[0]))
                    how.append(("cut", []))
        others = [t for t in by if t and t != own]
        if own and others:
            made.append((line, rng.choice(by[rng.choice(others)]), answer))
            how.append(("foreign", tags))
        said = rng.choice([question, question.lower(), question.rstrip("?.？。"), question.upper(), f"You asked: {question}", f"Q: {question}\nA:", f"{question}\n\nAnswer:", f'"{question}"', f"**{question}**", f"# {question}"])
        made.append((line, question, said))
        how.append(("echo", []))
        if shut and tags[0] == ANSWER:
            made.append((line, question, question + rng.choice([" ", "\n", "\n\n"]) + answer))
            how.append(("before", tags))
        if rng.random() < 0.2:
            p = rng.choice(PLACEHOLDERS)
            made.append((line, question, rng.choice(["{}", "({})", '"{}"', "Answer: {}", "<answer>{}</answer>", '{{"answer": {}}}', "**{}**", "{}."]).format(rng.choice([p, p.upper(), p.capitalize()]))))
            how.append(("nothing", []))
    pairs = Pairs(pa.array([q for _, q, _ in made], pa.string()), pa.array([a for *_, a in made], pa.string()))
    out: list[list[int] | None] = []
    for k, ((kind, tags), own) in enumerate(zip(how, pairs.seeds(), strict=True)):
        mine = slice(pairs.first[k], pairs.first[k] + pairs.size[k])
        if not own:
            out.append(None)
        elif kind == "as":
            out.append(tags)
        elif kind == "cut":
            out.append([*own[:-1], UNFINISHED])
        elif kind == "foreign":
            told = len(own) == len(tags) and bool((pairs.foreign[mine] >= 2).any())
            out.append([FOREIGN if t in (ANSWER, FOREIGN) and (x > 0 or c >= TABLE) else ANSWER if t == FOREIGN else t for t, x, c in zip(tags, pairs.foreign[mine], pairs.kind[mine], strict=True)] if told else None)
        elif kind == "echo":
            out.append([t if t == NOTHING else ECHO for t in own])
        elif kind == "before":
            out.append([ECHO] * (len(own) - len(tags)) + tags if len(own) > len(tags) else None)
        else:
            out.append([NOTHING] * len(own))
    return [(line, pairs.edges, pairs.slots, pairs.first[k], pairs.size[k]) for k, (line, *_) in enumerate(made)], out


def _forward_backward(emit: np.ndarray, step: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of tags and of neighbouring tags; emit is (clauses, tags), or (sequences, clauses, tags) with the size of each sequence."""
    if emit.ndim == 2:
        one, two = _forward_backward(emit[None], step, np.array([len(emit)]))
        return one[0], two[0]
    rows, n, _ = emit.shape
    a, b = np.empty_like(emit), np.zeros_like(emit)
    a[:, 0] = emit[:, 0]
    lse = lambda x, axis: (top := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - top).sum(axis=axis))
    for i in range(1, n):
        a[:, i] = emit[:, i] + lse(a[:, i - 1, :, None] + step[None], 1)
    for i in range(n - 2, -1, -1):
        new = lse(step[None] + (emit[:, i + 1] + b[:, i + 1])[:, None, :], 2)
        b[:, i] = np.where((i + 1 < sizes)[:, None], new, 0)
    z = lse(a[np.arange(rows), sizes - 1], 1)
    inside = np.arange(n)[None] < sizes[:, None]
    one = np.exp(a + b - z[:, None, None]) * inside[:, :, None]
    if n == 1:
        return one, np.zeros((rows, 0, TAGS, TAGS))
    both = np.where(inside[:, 1:, None, None], a[:, :-1, :, None] + step[None, None] + (emit[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None], -np.inf)
    return one, np.exp(both)


def train(slots: list[np.ndarray], counts: list[np.ndarray], tags: list[np.ndarray], rounds: int = 6, rate: float = 0.15, batch: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Weights of clause features and of neighbouring tags, by AdaGrad on the conditional likelihood of batches of sequences; counts are features by clause."""
    w, step = np.zeros((WIDTH, TAGS)), np.zeros((TAGS, TAGS))
    seen, seen_step = np.full((WIDTH, TAGS), 1e-4), np.full((TAGS, TAGS), 1e-4)
    order = np.random.default_rng(5)
    size = np.array([len(t) for t in tags])
    like = np.argsort(size, kind="stable")
    batches = [like[i : i + batch] for i in range(0, len(like), batch)]
    for r in range(rounds):
        for k in order.permutation(len(batches)):
            rows = batches[k]
            sizes, n = size[rows], int(size[rows].max())
            flat = np.concatenate([slots[i] for i in rows])
            per = np.concatenate([counts[i] for i in rows])
            begin = np.cumsum(per) - per
            where = np.arange(n)[None] < sizes[:, None]
            emit = np.zeros((len(rows), n, TAGS))
            emit[where] = np.add.reduceat(w[flat], begin, axis=0)
            one, two = _forward_backward(emit, step, sizes)
            truth = np.concatenate([tags[i] for i in rows])
            g = one[where]
            g[np.arange(len(truth)), truth] -= 1
            used, inverse = np.unique(flat, return_inverse=True)
            spread = np.repeat(np.arange(len(per)), per)
            total = np.stack([np.bincount(inverse, g[spread, t], len(used)) for t in range(TAGS)], axis=1)
            seen[used] += total * total
            w[used] -= rate * total / np.sqrt(seen[used])
            if n > 1:
                d = two.sum((0, 1))
                follows = np.concatenate([np.arange(1, s) + e for s, e in zip(sizes, np.cumsum(sizes) - sizes, strict=True)])
                np.subtract.at(d, (truth[follows - 1], truth[follows]), 1)
                seen_step += d * d
                step -= rate * d / np.sqrt(seen_step)
    return w, step


def decode(emit: np.ndarray, step: np.ndarray, sizes: np.ndarray | None = None) -> list[int] | np.ndarray:
    """The best tags (Viterbi) of a sequence, or of sequences that follow one another, each of its size."""
    if sizes is None:
        return decode(emit, step, np.array([len(emit)])).tolist()
    first = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    best = emit[first[order]].copy()
    back: list[np.ndarray] = []
    active = len(order)
    size = sizes[order]
    for i in range(1, int(size[0]) if len(size) else 0):
        active = int(np.searchsorted(-size, -i, "left"))  # sequences of more than i clauses come first
        through = best[:active, :, None] + step[None]
        back.append(through.argmax(1))
        best[:active] = through.max(1) + emit[first[order[:active]] + i]
    tags = np.zeros(len(emit), np.int64)
    now = best.argmax(1) if len(best) else np.empty(0, np.int64)
    for i in range((int(size[0]) if len(size) else 0) - 1, -1, -1):
        active = int(np.searchsorted(-size, -i, "left"))
        tags[first[order[:active]] + i] = now[:active]
        if i:
            now[:active] = back[i - 1][np.arange(active), now[:active]]
    return tags


SLICE_BYTES = 1_000_000
DEFECTS = np.array([None, "empty", "refusal", "question_copy", "other_language", "truncated"], dtype=object)


def defects(pairs: Pairs, tags: np.ndarray) -> np.ndarray:
    """The defect of each pair by what its tags cover, the first that fits: nothing, only a refusal, only the question, more in another language than not, an unfinished end."""
    cover = np.zeros((TAGS, pairs.n))
    for t in range(TAGS):
        cover[t] = np.bincount(pairs.text[tags == t], pairs.length[tags == t], pairs.n)
    sure = np.bincount(pairs.text[(tags == FOREIGN) & (pairs.foreign > 0)], minlength=pairs.n) > 0  # a table or code alone has no language
    said = cover[[ANSWER, UNFINISHED, FOREIGN]].sum(0)
    rest = cover[[REFUSAL, ECHO, COURTESY]].sum(0)
    last = np.full(pairs.n, -1)
    some = pairs.size > 0
    last[some] = tags[(pairs.first + pairs.size - 1)[some]]
    kind = np.select(
        [said + rest == 0, (said == 0) & (cover[REFUSAL] > 0), (said == 0) & (cover[ECHO] > 0), sure & (cover[FOREIGN] > cover[ANSWER]), last == UNFINISHED], [1, 2, 3, 4, 5], 0)
    return DEFECTS[kind]


def fit(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """A field trained on a sample of the pairs; None without pairs to learn from. Examples are made in tasks of TASK_ROWS pairs, wherever these lay."""
    usable = pairs.where("question is not null and answer is not null")
    total = usable.count()
    if not total:
        return None
    picked = usable.where(F.pmod(F.xxhash64("line_no", F.lit(13)), F.lit(1_000_000)) < int(min(1.0, TRAIN_ROWS / total) * 1_000_000)).select("line_no", "question", "answer")
    tasks = max(1, min(total, TRAIN_ROWS) // TASK_ROWS)

    def run(frames):
        held = list(frames)
        if not held:
            return
        frame = pd.concat(held).sort_values(["line_no", "question", "answer"], kind="stable")  # about TASK_ROWS
        made, tags = _examples(list(zip(frame["line_no"].fillna(0).astype(int), frame["question"], frame["answer"], strict=True)))
        out = []
        for (line, edges, slots, first, size), t in zip(made, tags, strict=True):
            if t is not None:
                out.append((line, len(out), slots[edges[first] : edges[first + size]], np.diff(edges[first : first + size + 1]), t))
        yield pd.DataFrame(out, columns=["line_no", "k", "slots", "counts", "tags"])

    sample = picked.repartition(tasks, "line_no").mapInPandas(run, "line_no long, k int, slots array<int>, counts array<int>, tags array<int>").toPandas().sort_values(["line_no", "k"], kind="stable")
    if not len(sample):
        return None
    return train(*([np.asarray(x, np.int64) for x in sample[c]] for c in ("slots", "counts", "tags")))


def judged(pairs: DataFrame) -> DataFrame:
    """(line_no, defect): every row with a defect, once a row.

    A null, blank or invisible answer is empty, whatever the question. A null or blank question is in no language and can't be copied;
    repeated rows are judged alike; the error column plays no part. An empty table gives an empty result.
    """
    pairs = pairs.select(F.col("line_no").cast("long").alias("line_no"), "question", "answer")
    model = fit(pairs)

    def run(batches):
        w, step = model if model is not None else (np.zeros((WIDTH, TAGS)), np.zeros((TAGS, TAGS)))
        for batch in batches:
            questions, answers = batch.column(1).cast(pa.string()), batch.column(2).cast(pa.string())
            for a, b in codepoints.slices(answers, SLICE_BYTES):
                some = Pairs(questions.slice(a, b - a), answers.slice(a, b - a))
                kind = defects(some, decode(some.emissions(w), step, some.size))
                for i in np.flatnonzero(some.size == 0):  # symbols may say something
                    kind[i] = "empty" if is_empty(answers[a + int(i)].as_py()) else None
                found = np.flatnonzero(kind != None)  # noqa: E711
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(found)), pa.array(kind[found].tolist(), pa.string())], ["line_no", "defect"])

    return pairs.mapInArrow(run, "line_no long, defect string")
