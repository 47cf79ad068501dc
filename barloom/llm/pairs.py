"""Problem 4: broken prompt and response pairs."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+(?:[.,]\d+)*")
FENCE = re.compile(r"```[\w+-]*")
TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,80}>|<!--.*?-->", re.S)
NOTHING = {"null", "none", "n/a", "na", "nil", "nan", "undefined", "nothing", "no response", "no answer", "empty", "(empty)", "keine", "nichts", "keine antwort", "leer", "aucun", "aucune", "rien", "vide", "pas de réponse"}

# How answers decline, in lower case with straight apostrophes. A rule is a list of beginnings and one of endings, each of which may
# follow each; phrases that stand for themselves come after.
DECLINES = {
    "en": ("i can't|i cannot|i can not|i could not|i'm unable to|i am unable to|i'm not able to|i am not able to|i won't|i will not|i'm not allowed to|i am not allowed to|i'm not permitted to|i am not permitted to|i'm not in a position to|i am not in a position to|i must decline to|i have to decline to|i decline to|i refuse to",
           "help with|help you|assist|answer|respond to|discuss|comment|speculate|provide|give|offer|share|recommend|fulfil|fulfill|comply|advise|engage|make that call|express an opinion"),
    "de": ("kann ich|kann ich leider|kann ich ihnen|kann ich dir|kann ich ihnen leider|darf ich|darf ich leider|möchte ich|möchte ich lieber|will ich",
           "nicht helfen|nicht weiterhelfen|nicht behilflich sein|nicht beantworten|nicht beurteilen|nicht kommentieren|nicht nachkommen|nichts sagen|keine auskunft|keine empfehlung|keine anlageberatung|keine einschätzung|keine antwort|mich nicht äußern"),
    "fr": ("je ne peux pas|je ne peux malheureusement pas|je ne puis|je ne suis pas en mesure de|je ne suis pas autorisé à|je ne suis pas habilité à|je ne souhaite pas|je préfère ne pas|je refuse de|il m'est impossible de|il ne m'est pas possible de",
           "répondre|vous répondre|vous aider|t'aider|aider|fournir|vous fournir|donner|vous donner|me prononcer|commenter|conseiller|vous conseiller|discuter|accéder à"),
    "es": ("no puedo|no me es posible|no estoy en condiciones de|no estoy autorizado a|no estoy autorizado para|prefiero no|debo negarme a", "ayudar|ayudarle|ayudarte|responder|contestar|proporcionar|ofrecer|dar consejos|dar una recomendación|comentar|opinar"),
    "it": ("non posso|non sono in grado di|non mi è possibile|non sono autorizzato a|preferisco non|devo rifiutare di", "aiutar|rispondere|fornire|dare consigli|dare una raccomandazione|commentare|esprimer"),
    "nl": ("kan ik|kan ik helaas|mag ik|wil ik", "niet helpen|niet mee helpen|niet beantwoorden|niet op ingaan|geen antwoord|geen advies|geen aanbeveling"),
    "pt": ("não posso|não consigo|não me é possível|não estou autorizado a|prefiro não", "ajudar|responder|fornecer|dar conselhos|dar uma recomendação|comentar|opinar"),
}
REFUSALS = """
as a language model|as an ai language model|as an ai,|as an ai assistant|i'm just an ai|i am just an ai|what i can assist with|can't help with that|unable to provide investment|i'd rather not
i must decline|i have to decline|i respectfully decline|i have to pass on|i'll have to pass|i must refuse|can be given here
not be appropriate for me|not appropriate for me|isn't appropriate for me|my guidelines don't allow|my guidelines do not allow|against my guidelines|not permitted to answer|i'm not allowed to|i am not allowed to
i do not have the ability|i don't have the ability|i'm not qualified|i am not qualified|i'm not comfortable|i am not comfortable
nicht behilflich sein|ist mir nicht möglich|ist mir leider nicht möglich|bin ich nicht in der lage|als sprachmodell|als ki-modell|muss ich ablehnen|steht mir nicht zu|kann ich mich nicht äußern|darf ich mich nicht äußern|ich kann dazu nichts sagen
je ne suis pas en mesure|il m'est impossible de|je dois refuser|je dois décliner|je ne suis pas autorisé|en tant que modèle de langage|en tant qu'ia|ne me permettent pas de
lo siento, pero no puedo|como modelo de lenguaje|mi dispiace, ma non posso|come modello linguistico|ik kan hier niet mee helpen|als taalmodel|como modelo de linguagem|lamento, mas não posso
"""

# Function words (articles, pronouns, prepositions, conjunctions, auxiliaries, particles) by which texts of these languages are told apart.
STOPWORDS = {
    "en": "the a an this that these those i you he she it we they them his her its our their who which what where when why how and or but nor if than because while although though since until unless of to in on at by for from with without into over under after before between through against about most more some any all no not is are was were be been being am has have had do does did will would shall should can could may might must there still around given than",
    "de": "der die das des dem den ein eine einen einem einer eines dieser diese dieses diesem jener ich du er sie es wir ihr mich mir dich ihm ihn ihnen uns euch sich mein sein seine ihre unser wer was welche welcher welches wie wo wann warum und oder aber denn weil dass wenn ob als während obwohl sobald solange bevor nachdem in im an am auf aus bei beim mit nach von vom zu zum zur über unter vor zwischen für durch gegen gegenüber ohne um nicht kein keine auch nur noch schon sehr kaum ist sind war waren wird werden wurde würde hat haben hatte kann können muss soll dürfte bleibt",
    "fr": "le la les l un une des du de d ce cet cette ces je tu il elle on nous vous ils elles me te se s leur leurs lui son sa ses mon ma mes notre votre qui que qu dont où quand comment pourquoi quel quelle quels quelles et ou mais donc car ni si comme lorsque puisque tandis alors après avant dans sur sous en par pour avec sans vers chez entre contre depuis au aux à y ne n pas plus moins très aussi encore est sont était étaient sera serait être a ont avait avoir fait peut devrait tenu reste",
    "es": "el la los las lo un una unos unas del de al este esta estos estas ese esa eso yo tú él ella nosotros ellos ellas me te se le les nos su sus mi tu que quien cuál cuando donde cómo por porque para con sin sobre entre hasta desde hacia según tras y e o u ni pero si como aunque mientras no más menos muy ya también apenas es son era fue será sería está están estaba ha han había hay sigue puede debe en a ser frente",
    "it": "il lo la i gli le un uno una del dello della dei degli delle di al allo alla ai alle dal dalla nel nella nei sul sulla sui con per tra fra in da su a questo questa questi queste quello io tu lui lei noi voi loro mi ti si ci vi ne che chi cui quando dove come perché se e ed o ma non anche più meno molto ancora mentre quasi sotto rispetto è sono era erano sarà sarebbe essere ha hanno aveva può deve resta",
    "nl": "de het een dit dat deze die ik jij je hij zij ze wij we jullie hun hem haar ons mijn zijn wie wat welke waar wanneer waarom hoe en of maar want omdat als toen terwijl hoewel zodra dan in op aan bij met naar van voor door over onder tegen tussen uit om te ten tot na sinds niet geen ook nog al maar wel zeer nauwelijks is was waren wordt worden werd zou zouden heeft hebben had kan kunnen moet blijft er meer opzichte",
    "pt": "o a os as um uma uns umas do da dos das no na nos nas ao aos à pelo pela de em por para com sem sobre entre até desde este esta isso esse essa eu tu ele ela nós eles elas me te se lhe seu sua meu que quem qual quando onde como porque e ou mas nem se embora enquanto não mais menos muito já também ainda é são era foi será seria está estão ser tem têm tinha há pode deve fica",
}
LANGUAGE_NAMES = {
    "en": "english|englisch|anglais|inglés|inglese", "de": "german|deutsch|allemand|alemán|tedesco", "fr": "french|französisch|français|francés|francese",
    "es": "spanish|spanisch|espagnol|español|spagnolo", "it": "italian|italienisch|italien|italiano", "nl": "dutch|niederländisch|holländisch|néerlandais|holandés", "pt": "portuguese|portugiesisch|portugais|portugués",
}
LABELS = {"you", "asked", "q", "a", "question", "answer", "prompt", "response", "sie", "fragten", "frage", "antwort", "vous", "demandez", "avez", "demandé", "réponse", "user", "assistant", "instruction", "input", "the", "was", "is", "original"}

stopwords = {k: frozenset(v.split()) for k, v in STOPWORDS.items()}
asked_for = re.compile(r"(?i)\b(?:in|into|auf|ins|en|au|vers l'|al|to|zu)\s*(?:" + "|".join(f"(?P<{k}>{v})" for k, v in LANGUAGE_NAMES.items()) + r")\b")
TERMINAL = re.compile(r"[.!?。！？][\"'”’»)\]*_]*$")
BULLET = re.compile(r"^\s*(?:[-*•–]|\d{1,3}[.)])\s+\S")
WHOLE_SHORT = {"yes", "no", "ja", "nein", "oui", "non", "buy", "sell", "hold", "kaufen", "verkaufen", "halten", "acheter", "vendre", "garder", "true", "false", "ok"}


def straight(text: str) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text).replace("’", "'").replace("‘", "'").casefold())


def automaton_of_refusals():
    """Aho-Corasick automaton of the refusal phrases."""
    import ahocorasick

    a = ahocorasick.Automaton()
    ruled = {f"{head} {tail}" for heads, tails in DECLINES.values() for head in heads.split("|") for tail in tails.split("|")}
    for phrase in ruled | {p for line in REFUSALS.strip().splitlines() for p in line.split("|")}:
        a.add_word(straight(phrase), len(phrase))
    a.make_automaton()
    return a


class SuffixAutomaton:
    """Suffix automaton of a sequence of words: every run of the prompt's words is a path from the start."""

    def __init__(self, words: tuple[str, ...]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for w in words:
            cur = self.add(self.length[last] + 1, {})
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p < 0:
                self.link[cur] = 0
            else:
                q = self.next[p][w]
                if self.length[q] == self.length[p] + 1:
                    self.link[cur] = q
                else:
                    clone = self.add(self.length[p] + 1, dict(self.next[q]))
                    self.link[clone] = self.link[q]
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def add(self, length: int, edges: dict[str, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(-1)
        return len(self.next) - 1

    def covered(self, words: list[str], least: int) -> list[bool]:
        """Which words lie in a run of ``least`` or more words that the prompt has too."""
        marks = [False] * len(words)
        state = run = done = 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                run += 1
            else:
                state = run = 0
            if run >= least:
                start = max(done, i - run + 1)
                marks[start : i + 1] = [True] * (i + 1 - start)
                done = i + 1
        return marks


@lru_cache(maxsize=256)
def automaton_of(words: tuple[str, ...]) -> SuffixAutomaton:
    return SuffixAutomaton(words)


def said(response: str) -> str:
    """What a response says: without tags, fences, Markdown marks and empty structures."""
    return TAG.sub(" ", FENCE.sub(" ", response)).strip()


def is_empty(response: str | None) -> bool:
    if response is None or (isinstance(response, float) and response != response):
        return True
    text = said(response)
    if not WORD.search(text):
        return True
    bare = re.sub(r"[\s\"'`*_#>.()\[\]{}:;,!-]+", " ", straight(text)).strip()
    if bare in NOTHING or straight(text).strip(" .\"'`*_") in NOTHING:
        return True
    if text[:1] in "{[":
        try:
            return not any(WORD.search(v) and straight(v) not in NOTHING for v in leaves(json.loads(text)))
        except (ValueError, RecursionError):
            return False
    return False


def leaves(value) -> Iterator[str]:
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            todo += v.values()
        elif isinstance(v, list):
            todo += v
        elif v is not None:
            yield str(v)


def is_copy(prompt: str, response: str, response_share: float, prompt_share: float) -> bool:
    asked = WORD.findall(straight(prompt))
    words = WORD.findall(straight(said(response)))
    if not asked or not words:
        return False
    marks = automaton_of(tuple(asked)).covered(words, min(2, len(asked)))
    size = lambda it: sum(map(len, it))
    own = [w for w, m in zip(words, marks) if not m]
    added = size(w for w in own if w not in LABELS)
    copied = size(w for w, m in zip(words, marks) if m)
    return copied >= response_share * (copied + added) and copied >= prompt_share * size(asked)


CLOSERS = {"}": "{", "]": "[", ")": "(", "”": "“", "»": "«"}


def open_delimiters(text: str, structure: bool) -> list[str]:
    """The delimiters left open at the end, by a stack; in a ``structure`` (JSON) strings count too."""
    stack: list[str] = []
    quoted = escaped = False
    for c in text:
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"' and structure:
            quoted = True
        elif c in "{[(" or (not structure and c in "“«"):
            stack.append(c)
        elif c in CLOSERS and stack and stack[-1] == CLOSERS[c]:
            stack.pop()
    return [*stack, *['"'] * quoted]


def is_truncated(prompt: str, response: str) -> bool:
    text = response.strip()
    fences = text.count("```")
    if fences % 2:
        return True
    if fences:
        inner = re.sub(r"^```[\w+-]*|```$", "", text).strip()
        if text.startswith("```") and text.endswith("```"):
            text = inner
        elif text.endswith("```"):
            return False
    if text[:1] in "{[":
        return bool(open_delimiters(text, True))
    text = TAG.sub(" ", text).strip()
    if not text:
        return False
    last = text.splitlines()[-1].strip()
    if TERMINAL.search(last) and not re.search(r"(?:\s|^)[-–,;:]$", last):
        return False
    if open_delimiters(text, False):
        return True
    words = WORD.findall(straight(last))
    if re.search(r"[,;:]$|\s[-–—]$|\w[-–]$", last) or not words:
        return True
    every = frozenset().union(*stopwords.values())
    if BULLET.match(last):
        return words[-1] in every and not words[-1].isdigit()
    whole = WORD.findall(straight(text))
    if len(whole) <= 3:
        asked = set(WORD.findall(straight(prompt)))
        return not all(w in WHOLE_SHORT or w in asked or w.replace(".", "").isdigit() for w in whole)
    lines = [x for x in text.splitlines() if x.strip()]
    if len(lines) > 2 and not any(TERMINAL.search(x.strip()) for x in lines):
        return words[-1] in every  # a plain list, one entry a line
    return True


#: A word that several languages have is a part of a vote for each, the smaller the more have it.
share_of = {w: 1 / sum(w in s for s in stopwords.values()) ** 2 for w in frozenset().union(*stopwords.values())}


def votes(text: str) -> dict[str, float]:
    words = re.findall(r"(?<!\w)[^\W\d_]+(?:'[^\W\d_]+)?(?!\w)", straight(text))  # letters of a code with digits are no word
    parts = [p for w in words for p in (w.split("'") if "'" in w else [w])]
    return {k: sum(share_of[p] for p in parts if p in s) for k, s in stopwords.items()}


def language(text: str, least: int) -> str | None:
    """The language with the most votes; None with few votes or a tie."""
    v = sorted(votes(text).items(), key=lambda x: -x[1])
    return v[0][0] if v[0][1] >= least and v[0][1] > v[1][1] else None


def is_other_language(prompt: str, response: str) -> bool:
    """Whether the votes for the response clearly go to a language that is neither the prompt's nor asked for in it."""
    wanted = {k for m in asked_for.finditer(prompt) for k, x in m.groupdict().items() if x}
    v = votes(asked_for.sub(" ", prompt))
    top = max(v.values())
    if top <= 0:
        return False
    expected = wanted | {k for k in v if v[k] == top}
    text = said(response)
    if text[:1] in "{[":
        try:
            text = " ".join(x for x in leaves(json.loads(text)) if " " in x)
        except (ValueError, RecursionError):
            text = " ".join(x for x in re.findall(r'"((?:[^"\\]|\\.)*)', text) if " " in x)
    got = language(text, 2)
    if got is None or got in expected:
        return False
    mine = votes(text)
    return mine[got] >= 1.5 * max(mine[k] for k in expected)


def defect_of(prompt: str | None, response: str | None, refusals, response_share: float, prompt_share: float) -> str | None:
    if is_empty(response):
        return "empty"
    prompt = prompt if isinstance(prompt, str) else ""
    if next(refusals.iter(straight(said(response))), None):
        return "refusal"
    if is_copy(prompt, response, response_share, prompt_share):
        return "copy"
    if is_truncated(prompt, response):
        return "truncated"
    if is_other_language(prompt, response):
        return "language"
    return None


def broken_pairs(calls: DataFrame, response_share: float = 0.8, prompt_share: float = 0.5) -> DataFrame:
    """Defective pairs: call_id, defect (``empty``, ``refusal``, ``copy``, ``truncated`` or ``language``, the first that holds).

    ``calls``: call_id, prompt, response; other columns are ignored, also any error message. A null response is empty; with a null
    prompt nothing can be a copy or in another language. Rows with a null call_id are left out, repeated rows are judged
    one by one, an empty table gives an empty result.

    * copy: a suffix automaton of the prompt's words is walked with the response; the runs of two or more words that the prompt has too
      make up ``response_share`` of the response's letters, labels aside, and ``prompt_share`` of the prompt's.
    * refusal: an Aho-Corasick automaton of refusal phrases in English, German, French, Spanish, Italian and Dutch.
    * truncated: delimiters left open on a stack, or a last line that isn't the end of a sentence, a list entry or a short answer.
    * language: the votes of stopwords, of seven languages, for the response against those for the prompt.

    One pass without a shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refusals = automaton_of_refusals()
        for batch in batches:
            found = [(c, d) for c, p, r in zip(batch["call_id"], batch["prompt"], batch["response"]) if (d := defect_of(p, r, refusals, response_share, prompt_share))]
            yield pd.DataFrame(found, columns=["call_id", "defect"]).astype({"call_id": "int64", "defect": "object"})

    rows = calls.select(F.col("call_id").cast("bigint").alias("call_id"), "prompt", "response").where("call_id is not null")
    return rows.mapInPandas(run, "call_id long, defect string")
