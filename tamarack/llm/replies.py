"""Defective replies to questions that ask for a SQL statement, with the kind of defect.

A reply is taken apart into thinking, wrappers, statement and prose. Copies of the question
are found by aligning both word sequences (shingle containment and longest common
subsequence), refusals by aligning the words with refusal phrases, breaks by reading the
statement to its end, and languages by their function words and scripts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.sqltext import tokens as sql_tokens

EMPTY, COPIED, REFUSAL, TRUNCATED, OTHER_LANGUAGE = "empty", "copied_question", "refusal", "truncated", "other_language"

_THINK = re.compile(r"<think(?:ing)?>.*?</think(?:ing)?>", re.S | re.I)
_OPEN_THINK = re.compile(r"<think(?:ing)?>(.*)\Z", re.S | re.I)
_FENCE = re.compile(r"```[ \t]*[A-Za-z]*[ \t]*")
_MARK = "\x01"
_START = re.compile(r"(?:\A|[\n;:>.!?。：\x01])[\s\x01]*(?:--[ \t]*)?(select\b|with\s+(?:recursive\s+)?[\"`]?\w+[\"`]?(?:\s*\Z|\s+as\b))", re.I)
_ANYWHERE = re.compile(r"\b(select\b(?=.*\bfrom\b)|with\s+[\"`]?\w+[\"`]?\s+as\s*\()", re.I | re.S)
_PIECE = re.compile(r"'(?:[^']|'')*'|‘[^’]*’|\"[^\"]*\"|`[^`]*`|--[^\n]*|;|\x01|\n[ \t\r]*\n\s*(?=\S)|[^'\"`‘;\x01\n-]+|.", re.S)
_SQL_WORD = re.compile(r"(?:select|from|where|and|or|on|join|left|right|inner|outer|full|cross|group|order|having|limit|offset|union|except|intersect|with|as|case|when|then|else|end)\b|[(),]", re.I)
_WORD = re.compile(r"[^\W_]+")
_IN_NUMBER = re.compile(r"(?<=\d)[^\w\s](?=\d)")
_END = re.compile(r"[.!?。！？)\]\"'»”…]\W*\Z")

#: Words that label a question or an answer and add nothing to it.
_LABELS = set("question query sql postgresql postgres answer asked q a prompt user input statement frage antwort abfrage anweisung pregunta consulta respuesta réponse requête you the here is assistant".split())

#: Phrases by which an answer is declined, as words.
_REFUSALS = [
    tuple(p.split())
    for p in (
        "i can t help|i cannot help|can t assist|cannot assist|i am not able to|i m not able to|i am unable to|i m unable to|must decline|have to decline|i decline|i won t|i will not|i refuse|no query can be offered|not have permission|don t have permission"
        "|not allowed to|not permitted to|outside of what i may|have to pass on|can t answer|cannot answer|can t provide|cannot provide|cannot comply|can t comply|against my policy|i cannot do|i can t do|cannot write|can t write|cannot fulfil|cannot fulfill"
        "|muss ich ablehnen|ich muss ablehnen|ich lehne ab|darf ich keine|ich darf keine|darf ich nicht|nicht helfen|kann ich nicht|ich kann keine|geht leider nicht|nicht erlaubt"
        "|no puedo|debo rechazar|tengo que rechazar|no me está permitido|no tengo permiso|me niego a"
        "|je ne peux pas|je ne peux|je dois refuser|je dois décliner|pas le droit|pas autorisé|je refuse|pas en mesure"
        "|não posso|devo recusar|tenho de recusar|não me é permitido|não tenho permissão|non posso|devo rifiutare|non mi è permesso|kan ik niet|ik kan niet|moet ik weigeren|mag ik niet|ik mag geen"
        "|nie mogę|muszę odmówić|nie wolno mi|не могу|вынужден отказать|должен отказать|не имею права|мне не разрешено"
    ).split("|")
]
_REFUSAL_MARKS = re.compile("できません|お断り|応じられません|許可されていません|无法|不能提供|拒绝|할 수 없")

#: Function words of languages that replies and questions are written in.
_FUNCTION_WORDS = {
    "en": "the a an is are was of to for and in it this that you your with from on by which what who only asked more change if see here needs be will we i not without should do rows want have has below above under after at least most there their them any each into how many all show list find give or than never no where within keep they're sure needs holds then first it's",
    "de": "der die das und ist nicht ein eine einen einem für mit von zu auf wir ich aus dem den des bei werden wird nur oder wenn bitte diese dieser so lässt sich hier danach zuerst dafür brauchen es wurden haben hat nach unter über je welche wer wie mehr als falls dabei im ab höchstens mindestens sie zwischen zeilen bleiben frage abfrage gern beantworten",
    "es": "el la los las de que y en un una por para con se no su lo es si más como del esta solo primero luego quedan aquí cambie caso filas al qué quién cuáles cuántos tienen desde después hasta entre sin sobre son fueron está claro así puede pides ver necesita segunda columna",
    "fr": "le la les de des du et en un une pour par avec que qui se ne pas est sont il elle vous nous je si plus voici cette seules sans cas puis bien sûr cela au aux dans sur quels quelles quel ont depuis après ce entre d l n s qu ou moins comment voir",
    "pt": "o a os as de do da que e em um uma para com se não por mais é como esta você isso apenas sem caso depois primeiro aqui está claro assim ficam pelo pela das dos no na ou são linhas pedidas coluna decide tabela",
    "it": "il lo la i gli le di che e in un una per con si non sono è questo questa ecco solo prima poi della dei delle del nel dal alla come più se righe restano",
    "nl": "de het een en van is niet dat die in op te zijn voor met als uit ik wij we alleen over bij hier kan worden daarna eerst deze natuurlijk zo vraag rijen geen naar wat je nodig hebt zonder gelijke stand",
    "pl": "i w z na do się nie jest to są że po oto tak można tylko przy potem najpierw zapytanie bez wiersze tabeli zostają oczywiście ta od dla oraz a druga decyduje",
    "sv": "och att det som en ett är på av för med inte den till från här bara om eller de rader frågan",
    "da": "og at det som en et er på af for med ikke den til fra her kun hvis eller de rækker spørgsmålet",
    "cs": "a v na se je to že s z do pro jen nebo tady dotaz řádky první pak",
    "tr": "ve bir bu için ile da de olan önce sonra yalnızca sorgu satırlar işte",
}
_OWNERS = Counter(w for ws in _FUNCTION_WORDS.values() for w in set(ws.split()))
_WEIGHTS: dict[str, list[tuple[str, float]]] = {}
for _lang, _ws in _FUNCTION_WORDS.items():
    for _w in set(_ws.split()):
        _WEIGHTS.setdefault(_w, []).append((_lang, 1 / _OWNERS[_w]))
_SCRIPTS = [("ja", re.compile("[぀-ヿ]")), ("zh", re.compile("[一-鿿]")), ("ko", re.compile("[가-힯]")), ("cyrillic", re.compile("[Ѐ-ӿ]")), ("ar", re.compile("[؀-ۿ]")), ("el", re.compile("[Ͱ-Ͽ]")), ("he", re.compile("[֐-׿]")), ("hi", re.compile("[ऀ-ॿ]")), ("th", re.compile("[฀-๿]"))]


def words(text: str) -> list[str]:
    return _WORD.findall((text if text.isascii() else unicodedata.normalize("NFKC", text)).casefold())


def language(text: str, least: float = 1.0) -> tuple[str | None, dict[str, float]]:
    """The language with the most function words (or the script that fills a third of the letters), and all scores; None without evidence."""
    if not text.isascii():
        n = sum(map(str.isalpha, text)) or 1
        for name, pattern in _SCRIPTS:
            if len(pattern.findall(text)) * 3 >= n:
                return name, {name: 9.0}
    scores: dict[str, float] = {}
    for w in words(text):
        for lang, x in _WEIGHTS.get(w, ()):
            scores[lang] = scores.get(lang, 0.0) + x
    best = max(scores, key=scores.__getitem__, default=None)
    return (best, scores) if best and scores[best] >= least else (None, scores)


def common_subsequence(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            keep = row[j + 1]
            row[j + 1] = last + 1 if x == y else max(keep, row[j])
            last = keep
    return row[-1]


def copies_question(question: str, body: str) -> bool:
    """Whether the words of ``body``, but for labels, are those of the question: once or more, in part or with small changes."""
    # 2,020.75 and 2020-11 are also written 202075 and 202011
    asked = words(_IN_NUMBER.sub("", question))
    said = words(_IN_NUMBER.sub("", body))
    if not asked or not said:
        return False
    own = set(asked)
    said = [w for w in said if w in own or w not in _LABELS]
    if not said or (len(said) < 3 and len(said) < len(asked)):
        return False
    k = min(3, len(said), len(asked))
    round_ = asked * (2 + len(said) // len(asked))  # the question after itself, for replies that repeat it
    known = {tuple(round_[i : i + k]) for i in range(len(asked) + k)}
    shingles = [tuple(said[i : i + k]) for i in range(len(said) - k + 1)]
    contained = sum(s in known for s in shingles) / len(shingles)
    if contained >= 0.8:
        return True
    needed = 0.85 * max(len(asked), len(said))
    # a common subsequence is no longer than the shorter side: where that falls short nothing needs aligning
    return min(len(asked), len(said)) >= needed and common_subsequence(asked, said) >= needed


def refuses(text: str) -> bool:
    """Whether the words align with a refusal phrase, with at most one word in between."""
    said = words(text)
    held = set(said)
    for phrase in _REFUSALS:
        if all(w in held for w in phrase):
            n = len(phrase)
            for i, w in enumerate(said):
                if w == phrase[0] and common_subsequence(list(phrase), said[i : i + n + 1]) == n:
                    return True
    return bool(_REFUSAL_MARKS.search(text))


#: A value that ends in an elided article at the end of all was cut at its doubled quote: 'Côte d'
_ELISION = re.compile(r"'[^']*\s[dlDL]'\s*\Z")
_DANGLING = set("select distinct from where and or not on having by group order limit offset between as join left right inner outer full cross in like ilike is exists case when then else with union except intersect over partition extract interval using nulls = < > <= >= <> != + - * / % || , . ( ::".split())
_CONDITION = {"where", "and", "or", "on", "having", "not"}


def incomplete(statement: str) -> bool:
    """Whether the statement breaks off: an open quote or bracket, a clause without its content, or nothing selected from."""
    rest = re.sub(r"'(?:[^']|'')*'|‘[^’]*’|\"[^\"]*\"|`[^`]*`|--[^\n]*", "x", statement)
    if re.search(r"['‘\"`]", rest) or _ELISION.search(statement):
        return True
    ts = sql_tokens(re.sub(r"--[^\n]*", " ", statement))
    if not ts or ts[-1] in _DANGLING and not (ts[-1] == "*" and len(ts) > 1 and ts[-2] in ("select", "distinct", ",")):
        return True
    depth, top, between, joined, condition, selected, from_ = 0, [], 0, False, -1, False, False
    for i, t in enumerate(ts):
        if t == "(":
            depth += 1
        elif t == ")":
            depth -= 1
        elif depth == 0:
            top.append(t)
            if t == "select":
                selected, from_ = True, False
            elif t == "from":
                from_ = True
            elif t == "between":
                between += 1
            elif t == "and" and between:
                between -= 1
                continue
            elif t == "join":
                joined = i == 0 or ts[i - 1] not in ("cross", "natural")
            elif t in ("on", "using"):
                joined = False
            if t in _CONDITION:
                condition = i
            elif t in ("group", "order", "limit", "offset", "union"):
                condition = -1
    if depth > 0 or between > 0 or joined or not selected or not from_:
        return True
    tail = ts[condition + 1 :] if condition >= 0 else []
    bare = [t for t in tail if t != "."]
    return bool(tail) and len(tail) <= 3 and len(bare) <= 2 and all(re.match(r"[^\W\d]", t) for t in bare) and not re.match(r"is_|has_|true|false", bare[-1])


def take_apart(reply: str) -> tuple[str, str | None, list[str], bool]:
    """(all that is left of the reply without thinking and wrappers, statement or None, prose before and after it, whether it ends while thinking)."""
    body = _THINK.sub("\n", reply)
    broken = _OPEN_THINK.search(body)
    if broken:
        body = body[: broken.start()]
    body = re.sub(r"</?think(?:ing)?>", "\n", body, flags=re.I)
    body = re.sub("[​‌‍⁠﻿]", "", body)
    marked = _FENCE.sub(_MARK, body)
    at = _START.search(marked) or _ANYWHERE.search(marked)
    whole = marked.replace(_MARK, "\n")
    if not at:
        return whole, None, [whole], bool(broken)
    start = end = at.start(1)
    after = len(marked)
    for piece in _PIECE.finditer(marked, start):
        t = piece.group()
        if t == ";" or t == _MARK:
            end, after = piece.start(), piece.end()
            break
        if t[0] == "\n" and t.strip() == "" and t.count("\n") > 1 and not _SQL_WORD.match(marked, piece.end()):
            end, after = piece.start(), piece.end()
            break
    else:
        end = len(marked)
    return whole, marked[start:end], [marked[:start].replace(_MARK, "\n"), marked[after:].replace(_MARK, "\n")], bool(broken)


def defect(question: str | None, reply: str | None) -> str | None:
    """The first defect that fits, or None for a sound reply."""
    if reply is None:
        return EMPTY
    whole, statement, prose, thinking = take_apart(reply)
    said = words(whole)
    if not said:
        if thinking and words(reply.split(">", 1)[-1]):
            return TRUNCATED
        return EMPTY
    if not set(said) - _LABELS:
        return TRUNCATED if thinking else EMPTY
    literal = statement is not None and not re.search(r"\bfrom\b", re.sub(r"'(?:[^']|'')*'|‘[^’]*’", "", statement), re.I)
    if statement is None or literal:
        if question is not None and copies_question(question, re.sub(r"(?i)\bselect\b|\bas\s+\w+\W*\Z", " ", whole) if literal else whole):
            return COPIED
        if refuses(whole):
            return REFUSAL
    if statement is not None:
        if incomplete(statement):
            return TRUNCATED
    elif thinking or not _END.search(whole.rstrip()) or whole.rstrip().endswith(("...", "…")):
        return TRUNCATED
    if question is not None:
        asked = language(question)[0] or "en"
        for part in prose:
            lines = [re.sub(r"^\s*--\s*", "", x) for x in part.split("\n") if words(x)]
            for line in lines:
                plain = re.sub(r"'[^']*'|‘[^’]*’|\"[^\"]*\"|`[^`]*`|\w*_\w*", " ", line)
                found, scores = language(plain)
                if found and found != asked and scores[found] > 1.25 * scores.get(asked, 0.0) and not copies_question(question, line):
                    return OTHER_LANGUAGE
    return None


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, questions, replies = (batch.column(i).to_pylist() for i in range(3))
        found = [defect(q, r) for q, r in zip(questions, replies, strict=True)]
        keep = [i for i, d in enumerate(found) if d]
        yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in keep], pa.string()), pa.array([found[i] for i in keep], pa.string())], ["id", "defect"])


def defective_replies(replies: DataFrame, prompts: DataFrame, key: str = "example_id", reply: str = "raw_output", prompt: str = "question") -> DataFrame:
    """(id, defect) of every reply with a defect.

    Replies meet their prompts by ``key``; a reply without a prompt is judged alone, never as
    a copy or by its language. Repeated rows count once; where a key has different
    replies or prompts, the smallest one that is not null counts. Null keys are left out and
    other columns ignored. Texts are read whole.
    """
    said = replies.select(F.col(key).cast("string").alias("id"), F.col(reply).alias("reply")).where("id is not null")
    asked = prompts.select(F.col(key).cast("string").alias("id"), F.col(prompt).alias("prompt")).where("id is not null and prompt is not null").groupBy("id").agg(F.min("prompt").alias("prompt"))
    once = said.groupBy("id").agg(F.min("reply").alias("reply"))
    return once.join(asked, "id", "left").select("id", "prompt", "reply").mapInArrow(_flag, "id string, defect string")
