"""Problem 10: template residue, filler, error pages and script notices in place of text."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.common import cut

FIELD = "\ue000"  # the token that stands for one unfilled field, of whatever notation

# Labelled exemplars. ``field``: contained in a window is enough. ``bag``: words that such passages are made of in any
# order. ``repeat``: a word that says nothing when it is all there is, twice or more. The rest: sentences.
EXEMPLARS: list[tuple[str, str]] = [
    ("field", FIELD),
    ("filler", "Replace this paragraph."), ("filler", "Replace this text."), ("filler", "Speech text goes here."), ("filler", "Your text goes here."),
    ("filler", "Insert text here."), ("filler", "Insert speech here."), ("filler", "Sample text."), ("filler", "Dummy text."), ("filler", "Dummy speech."),
    ("filler", "Placeholder text."), ("filler", "Placeholder."), ("filler", "Text to follow."), ("filler", "n/a - text to follow"), ("filler", "To be completed."),
    ("filler", "To be confirmed."), ("filler", "Coming soon."), ("filler", "Under construction."), ("filler", "TODO: paste speech"), ("filler", "TODO: insert text"),
    ("filler", "Texte à venir."), ("filler", "Texte à compléter."), ("filler", "Texte d'exemple."), ("filler", "Texte provisoire, à remplacer."), ("filler", "Insérer le texte ici."),
    ("filler", "Blindtext, bitte ersetzen."), ("filler", "Blindtext."), ("filler", "Text folgt."), ("filler", "Platzhalter."), ("filler", "Mustertext."), ("filler", "Beispieltext."),
    ("filler", "Hier steht der Text."), ("filler", "Text hier einfügen."), ("filler", "bla bla"), ("filler", "blah blah"), ("filler", "asdf"), ("filler", "qwerty"), ("repeat", "test"), ("repeat", "bla"), ("repeat", "blah"), ("repeat", "asdf"), ("repeat", "foo"), ("repeat", "text"), ("repeat", "dummy"),
    ("filler", "undefined"), ("filler", "null null"), ("filler", "NaN"), ("filler", "#REF!"), ("filler", "#N/A"), ("filler", "#VALUE!"), ("filler", "[object Object]"), ("filler", "xxxxx"),
    ("bag filler", "lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vestibulum curabitur pellentesque mauris"),
    ("error", "Page not found"), ("error", "Not found (error 404)"), ("error", "404 Not Found"), ("error", "Error 404"), ("error", "HTTP 410 Gone"), ("error", "502 Bad Gateway"), ("error", "504 Gateway Timeout"),
    ("error", "503 Service Unavailable"), ("error", "403 Forbidden"), ("error", "401 Unauthorized"), ("error", "400 Bad Request"), ("error", "500 Internal Server Error"), ("error", "Internal Server Error."), ("error", "429 Too Many Requests"),
    ("error", "The requested sitting report could not be located on this server."), ("error", "The requested page could not be found on this server."), ("error", "The upstream record service did not respond."), ("error", "The page you requested could not be found."),
    ("error", "This transcript has moved or no longer exists."), ("error", "This page has moved or no longer exists."), ("error", "The transcript service was unable to complete your request."), ("error", "The server encountered an error and could not complete your request."),
    ("error", "Error 486: session expired."), ("error", "Session expired."), ("error", "Sign in again to view the record."), ("error", "Please log in to continue."), ("error", "Access denied."), ("error", "Permission denied."),
    ("error", "The connection to the archive timed out."), ("error", "Connection timed out."), ("error", "Reload the page or contact the report desk (ticket 331)."), ("error", "Return to the index of debates."), ("error", "Return to the home page."),
    ("error", "Checking your browser before opening the record."), ("error", "Checking your browser before accessing the site."), ("error", "This may take up to 5 seconds."), ("error", "Load more… Please wait while the speech loads."), ("error", "Please wait while the page loads."), ("error", "Load more"), ("error", "Loading please wait"),
    ("error", "Error 503: backend fetch failed."), ("error", "Backend fetch failed."), ("error", "Service temporarily unavailable."), ("error", "Please try again in 5 minutes."), ("error", "Please try again later."), ("error", "Too many requests."), ("error", "Your client has been blocked for 60 seconds."), ("error", "Rate limit exceeded."),
    ("error", "Traceback (most recent call last):"), ("error", 'File "render.py", line 203, in <module>'), ("error", "KeyError: 'speaker'"), ("error", "java.lang.NullPointerException"), ("error", "at report.Render.speech(Render.java:12)"), ("error", "at report.Main.run(Main.java:12)"),
    ("error", "Warning: Undefined variable $speech in record on line 12"), ("error", "<b>Notice</b>: Undefined index: party"), ("error", "Notice: Undefined index: party"), ("error", "[render failed: field body is empty]"), ("error", "Fatal error: Uncaught exception in record on line 12"), ("error", "Segmentation fault (core dumped)"),
    ("error", "Erreur 404"), ("error", "Erreur interne du serveur."), ("error", "Page introuvable"), ("error", "Page non trouvée"), ("error", "Le document demandé n'existe plus."), ("error", "La page demandée n'existe pas."), ("error", "Le serveur ne répond pas."), ("error", "Veuillez réessayer plus tard."), ("error", "Accès refusé."), ("error", "Retour à la liste des séances."), ("error", "Retour à l'accueil."), ("error", "Service indisponible."), ("error", "Session expirée."),
    ("error", "Fehler 404"), ("error", "Seite nicht gefunden"), ("error", "Das angeforderte Protokoll existiert nicht (mehr)."), ("error", "Die angeforderte Seite existiert nicht mehr."), ("error", "Zurück zur Übersicht der Sitzungen."), ("error", "Zurück zur Startseite."), ("error", "Zugriff verweigert."), ("error", "Der Server antwortet nicht."), ("error", "Interner Serverfehler."), ("error", "Der Dienst ist zurzeit nicht erreichbar."), ("error", "Bitte versuchen Sie es in 5 Minuten erneut."), ("error", "Bitte versuchen Sie es später erneut."), ("error", "Sitzung abgelaufen."),
    ("bag script", "please enable activate turn switch on you must need to allow javascript scripts scripting and cookies in your browser and reload to read the verbatim report before the transcript can be displayed this viewer page site needs requires is disabled"),
    ("bag script", "bitte aktivieren aktiviere schalten sie ein javascript skripte und cookies in ihrem browser und laden sie die seite neu ohne kann der text nicht dargestellt werden diese ansicht seite benötigt um das protokoll anzuzeigen"),
    ("bag script", "veuillez activer activez javascript les scripts et les cookies dans votre navigateur et rechargez la page cette page exige nécessite pour consulter le compte rendu afficher le texte sans le texte ne peut être affiché"),
]

# Names of fields as templates for records have them (English, German, French); used only for the notations that have other
# uses in texts, as [chair] and <page>.
FIELD_NAMES = """agenda_title amendment_text article author bill_no chair committee constituency date datum day district figure fraktion
member minister motion_number name number orateur page party percentage place redner seconder session sitting_date speaker speaker_name
speech_text subject time title topic vote_result year name_of_speaker nom partei titel thema seite betrag montant ministre sujet"""
# Words of the bags that texts use for much else: no way to a bag unless they are rare in the corpus.
COMMON = """in do ut et ad ex ea eu id est non qui quis sed sit sunt sint esse enim nulla culpa
please turn switch on you must need to allow and your read the verbatim report before transcript can be displayed this page site needs requires is
bitte schalten sie ein und ihrem laden die seite neu kann der text nicht werden diese ansicht benötigt um das protokoll anzuzeigen ohne
veuillez les et dans votre cette page exige pour consulter le compte rendu afficher texte sans ne peut être la"""
INSIDE = 0.9  # of an exemplar's weight, where it stands in a longer passage
LONG = 6  # tokens from which an exemplar is also looked for inside longer passages
EDITORIAL = {"sic", "recte", "recto", "stet", "ibid", "idem", "laughter", "applause", "interruption"}
TAGS = "a abbr b blockquote body br center code dd div dl dt em font footer form h1 h2 h3 h4 h5 h6 head header hr html i img input li link main meta nav ol option p pre s script section select small span strike strong style sub sup table tbody td th thead title tr tt u ul"

NAME = r"[^\W\d_][\w]*(?:[._ -][^\W_]\w*){0,4}"
STRONG = re.compile(
    r"(?=[{<%$#@\[_?XxA-Z])(?:"  # what a field can begin with: all other places are passed by at once
    # double notations reach to their closing mark, over lines and quoted marks, but not over another opening one
    r"\{\{(?:[^{}\"']++|\"(?:[^\"{}]|\{(?!\{)|\}(?!\}))*+\"|'(?:[^'{}]|\{(?!\{)|\}(?!\}))*+'|[\"'])++\}\}|\{%(?:[^{%]++|%(?!\})|\{(?![%{]))++%\}|<%(?:[^<%]++|%(?!>)|<(?!%))++%>|[$#]\{[^{}]++\}"
    rf"|%%{NAME}%%|@@{NAME}@@|\[\[{NAME}\]\]|<<{NAME}>>"
    rf"|_{{2,}}{NAME.replace('[\\w]*', '[^\\W_]*')}_{{2,}}|\$[^\W\d_][\w.]*\$|(?<![\w%])%[^\W\d_][\w.]+%(?!\w)|\{{\d{{1,2}}\}}|(?<![\w%])%[sd](?!\w)"
    r"|\[(?:INSERT|INSÉRER|INSERER|ENTER|ADD)\s[^\[\]\n]{1,50}\]|\[[^\[\]\n]{1,50}\s(?:here|HERE|EINFÜGEN|einfügen|ERGÄNZEN|À COMPLÉTER|à compléter|A COMPLETER|ICI)\]|\[(?:TBC|TBD|TODO)\b"
    r"|\[\.{3}[^\W\d_][^\[\]\n]{0,40}\.{3}\]|\[[●•○■□]+\]|(?<![\w_])_{5,}(?![\w_])|(?<![\w?])\?{4,}|\bXX[./-]XX[./-]XX(?:XX)?\b|(?i:\bx{5,}\b)|\b[A-Z]{2,}(?:_[A-Z]{2,})+\b|\bTODO\b)"
)
WEAK = re.compile(r"\{([^\W\d_][\w.]{1,40})\}|<([^\W\d_][\w.]{1,40})>|\[([^\W\d_][\w.]{1,40}(?: [^\W\d_]\w{1,20})?)\]")
BREAK = re.compile(r"(?<=[.!?:…])\s+|\s*\n\s*|\s+[-–—]\s+|(?<=[.:])[-–—]+\s*|\s*[\[\]()]+\s*")
TOKEN = re.compile(rf"{FIELD}|\d+|[^\W\d_]+|#ref!|#n/a")
known_names = {re.sub(r"[^a-z]", "", n) for n in FIELD_NAMES.split()}
tags = set(TAGS.split())
common = set(COMMON.split())


def weak(match: re.Match) -> str:
    curly, angle, square = match.groups()
    if curly:
        return match.group() if curly.lower() in EDITORIAL else FIELD
    name = (angle or square).strip()
    plain = re.sub(r"[^a-z]", "", name.lower())
    if angle:
        return match.group() if name.lower() in tags or len(plain) < 3 else FIELD
    made = plain in known_names and (name.islower() or name.isupper() or name[0].isupper() and any(c in name for c in "._") or name[1:] != name[1:].lower())
    return FIELD if made or re.search(r"\w[_.]\w", name) else match.group()


MARK = re.compile(r"[{<\[%$@_#]|\?{4}|[xX]{2}|TODO")


def masked(text: str) -> str:
    return WEAK.sub(weak, STRONG.sub(f" {FIELD} ", text)) if MARK.search(text) else text


def tokens_of(passage: str) -> list[str]:
    """Lower-case words; every number is the same token."""
    return ["0" if t.isdigit() else t for t in TOKEN.findall(passage.casefold())]


def exemplars() -> list[tuple[str, list[str]]]:
    """Kind and tokens of each exemplar, and of its parts where it would be cut into several windows."""
    out = []
    for kind, text in EXEMPLARS:
        whole = tokens_of(text)
        out.append((kind, whole))
        parts = [tokens_of(p) for p in BREAK.split(text)]
        out += [(kind, p) for p in parts if len(p) > 1 and p != whole]
    return out


def vocabulary() -> set[str]:
    return {t for _, e in exemplars() for t in e}


def counter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents that hold each token, summed per batch before anything is shuffled; the empty token counts all documents."""
    for batch in batches:
        seen: Counter[str] = Counter({"": len(batch)})
        for text in batch["text"]:
            found = set(TOKEN.findall(text.casefold()))
            numbers = [t for t in found if t.isdigit()]
            if numbers:
                found.difference_update(numbers)
                found.add("0")
            seen.update(found)
        yield pd.DataFrame({"token": list(seen.keys()), "n": list(seen.values())})


class Index:
    """Inverted index of the exemplars with the corpus's weights of their tokens."""

    def __init__(self, held: dict[str, int], coverage: float, containment: float) -> None:
        self.coverage, self.containment = coverage, containment
        n = held.get("", 0)
        self.most = math.log(n + 2)
        weight = lambda t: math.log((n + 2) / (held.get(t, 0) + 1))
        self.exemplars = [(kind, Counter(set(e)) if kind.startswith("bag") else Counter(e)) for kind, e in exemplars() if kind != "repeat"]
        self.repeated = {e[0] for kind, e in exemplars() if kind == "repeat"}
        self.weights = {t: weight(t) for _, e in exemplars() for t in e}
        self.totals = [sum(self.weights[t] * k for t, k in e.items()) for _, e in self.exemplars]
        self.postings: dict[str, list[int]] = defaultdict(list)
        for i, (kind, e) in enumerate(self.exemplars):
            for t in self.ways(e, self.totals[i], kind.startswith("bag")):
                self.postings[t].append(i)
        self.leads = set(self.postings)

    def ways(self, e: Counter[str], whole: float, bag: bool) -> list[str]:
        """Tokens that lead to the exemplar, however frequent they are.

        Of a sentence its rarest ones, so many that a window without any of them can't hold enough of it; so nothing that would pass is
        left out. Of a bag all but the common words, and those too while they are rare (under some 4 % of 10,000 documents).
        """
        ranked = sorted(e.keys() - {"0"}, key=lambda t: (-self.weights[t], t))
        if bag:
            return [t for t in ranked if t not in common or self.weights[t] >= 0.35 * self.most]
        out, left = [], whole
        for t in ranked:
            if left < min(self.containment, INSIDE) * whole - 1e-9 * whole:
                break
            out.append(t)
            left -= self.weights[t] * e[t]
        return out

    def finder(self) -> Callable[[str], bool]:
        """Whether a text has any lead as a whole word, or a repeated word twice in a row: by an Aho-Corasick automaton, so that other texts and
        sentences are passed by at once."""
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for t in self.leads | self.repeated:
            automaton.add_word(t, (len(t), None if t in self.leads else re.compile(rf"[\W\d_]+{re.escape(t)}(?![^\W\d_])")))
        automaton.make_automaton()

        def leads(text: str) -> bool:
            text = text.casefold()
            for end, (n, again) in automaton.iter(text):
                # of letters only whole words count; what begins or ends with another sign is a token by itself
                if end + 1 < len(text) and text[end + 1].isalpha() and text[end].isalpha() or end >= n and text[end - n].isalpha() and text[end - n + 1].isalpha():
                    continue
                if again is None or again.match(text, end + 1):
                    return True
            return False

        return leads

    def matches(self, passage: list[str]) -> list[tuple[int, str, float, float, Counter[str]]]:
        """Exemplars that a passage may be: number, kind, weight that is shared, weight of the window's words of all exemplars, its other words.

        What is left to compare is whether the exemplar covers enough of the window once the weights of its other words are known.
        """
        own = Counter(passage)
        words = [t for t in own if t != "0"]
        if len(own) == 1 and len(passage) > 1 and passage[0] in self.repeated:
            whole = self.weights[passage[0]] * len(passage)
            return [(-1, "filler", whole, whole, Counter())]
        out = []
        for i in sorted({i for t in own.keys() & self.leads for i in self.postings[t]}):
            kind, e = self.exemplars[i]
            bag, n = kind.startswith("bag"), e.total()
            # a field is one token long, and so are the windows it is compared with
            windows = [own] if bag or len(passage) <= n or not (n >= LONG or kind == "field") else [own, *self.inside(passage, e, self.totals[i])]
            for window in windows:
                if window is own and len(words) == 1 and len(words[0]) == 1 and words[0] != FIELD:  # an initial isn't n/a
                    continue
                limited = not bag and len(window) > 1
                shared = {t: min(k, e[t]) if limited else k for t, k in window.items() if t in e}
                if sum(shared.values()) < self.coverage * window.total():  # so much of it, word for word
                    continue
                if bag:
                    # words of a bag are common somewhere: two of them may meet by chance in filler's Latin
                    if sum(t in e for t in words) < (3 if kind == "bag filler" else 2):
                        continue
                elif sum(self.weights[t] * min(k, window[t]) for t, k in e.items() if t in window) < (self.containment if window is own else INSIDE) * self.totals[i] - 1e-9:
                    continue
                known = sum(self.weights[t] * k for t, k in window.items() if t in self.weights)
                out.append((i, kind.removeprefix("bag "), sum(self.weights[t] * k for t, k in shared.items()), known, Counter({t: k for t, k in window.items() if t not in self.weights})))
        return out

    def inside(self, passage: list[str], e: Counter[str], whole: float) -> list[Counter[str]]:
        """The first window of the exemplar's own length that holds nearly all of it: it stands in a longer passage unmarked."""
        n = e.total()
        own = Counter(passage[:n])
        for start in range(len(passage) - n + 1):
            if start:
                own[passage[start - 1]] -= 1
                own[passage[start + n - 1]] += 1
            if sum(self.weights[t] * min(k, own[t]) for t, k in e.items()) >= INSIDE * whole:
                return [+own]
        return []


CANDIDATE = "row_no long, doc_id long, window long, exemplar long, kind string, shared double, known double, words array<string>, times array<long>"


def scanner(index: Index) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leads, row_no = index.finder(), TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                row_no += 1
                text = masked(text)
                if not leads(text):
                    continue
                for window, passage in enumerate(p for p in BREAK.split(text) if leads(p)):
                    for i, kind, shared, known, other in index.matches(tokens_of(passage)):
                        rows.append((row_no, doc, window, i, kind, shared, known, list(other.keys()), list(other.values())))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CANDIDATE.split(", ")])

    return run


def token_counts(documents: DataFrame) -> DataFrame:
    """How many documents hold each token (token, n), and under the empty token how many there are."""
    return documents.where("text is not null").select("text").mapInPandas(counter, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def residue(documents: DataFrame, coverage: float = 0.8, containment: float = 0.7, counts: DataFrame | None = None) -> DataFrame:
    """Documents with template residue: doc_id, kind (field, filler, error, script), passages (how many).

    ``documents``: doc_id, text; other columns are ignored. Null ids or texts and empty texts are no cases; a table of none gives
    none; repeated rows give repeated results, as they count for themselves. ``counts``: of :func:`token_counts`, where the documents are
    part of a larger corpus whose counts are to be used; else they are counted here.

    Each text is cut into passage windows (sentences and lines; for exemplars of several words and for fields also windows of their own
    length). Unfilled fields of all notations become one token. An exemplar is looked up in an inverted index by those of its own tokens
    that are rarest, however frequent they are, so residue that fills much of the corpus is found too; a window is residue if it holds
    ``containment`` of the exemplar's TF-IDF weight, and the exemplar covers ``coverage`` of the window's, and as much of it word for
    word. So a sentence that talks about an error page isn't: most of it is its own. A field is an exemplar of one token, so its
    windows are one token long and it is residue wherever it stands. All weights come from document counts over the whole corpus.

    Runs two jobs: one counts the documents that hold each token and cuts it off with a checkpoint, one fetches the counts of the exemplars' tokens
    (a fixed number, some 500). A second pass looks for windows that may be residue; only their other words are joined with the counts.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    counted = cut(token_counts(docs)) if counts is None else counts
    held = {r["token"]: r["n"] for r in counted.where(F.col("token").isin("", *sorted(vocabulary()))).collect()}
    n = held.get("", 0)
    found = docs.mapInPandas(scanner(Index(held, coverage, containment)), CANDIDATE)
    case = ["row_no", "doc_id", "window", "exemplar", "kind", "shared", "known"]
    words = found.select(*case, F.explode_outer(F.arrays_zip(F.col("words").alias("token"), F.col("times").alias("k"))).alias("x")).select(*case, "x.token", "x.k")
    weight = F.when(F.col("token").isNull(), 0.0).otherwise(F.ln(F.lit(n + 2.0) / (F.coalesce("n", F.lit(0)) + 1.0)) * F.col("k"))
    weighed = words.join(counted, "token", "left").groupBy(*case).agg(F.sum(weight).alias("other"))
    covered = weighed.where(F.col("shared") >= coverage * (F.col("known") + F.col("other")) - 1e-9)
    windows = covered.groupBy("row_no", "doc_id", "window").agg(F.min_by("kind", "exemplar").alias("kind"))
    kinds = windows.groupBy("row_no", "doc_id", "kind").agg(F.count("*").alias("n"), F.min("window").alias("first"))
    return kinds.groupBy("row_no", "doc_id").agg(F.max_by("kind", F.struct("n", -F.col("first"))).alias("kind"), F.sum("n").alias("passages")).drop("row_no")


def without_residue(documents: DataFrame, **options: float) -> DataFrame:
    """The documents that are free of residue; those with a null text or id are kept."""
    return documents.join(residue(documents, **options).select("doc_id").distinct(), "doc_id", "left_anti")
