"""What a text says about itself: labels by terms, sections of extracted text, quality items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, clean_extracted, contains_any, sentences, strip
from .screening import all_matches, first_match

# Fixed values: (label, terms of which one must occur), and the label without any.
MINING = "process mining|process discovery|conformance|event log"
STOCHASTIC = "markov|petri net|simulation|stochastic|monte carlo"
SOFTWARE = "software|github|jira|devops|ci/cd|pull request|commit|repository|requirements engineering|testing"
SOFTWARE_STRICT = "software|github|jira|devops|ci/cd|repository|commit"
RELEVANCE = [
    ("Alta: trata diretamente de mineração de processos aplicada ao desenvolvimento de software.", "process mining|event log|conformance checking|process discovery"),
    ("Alta: aborda modelagem ou simulação de processos de software com potencial analítico forte para a SLR.", "simulation|petri net|markov|digital twin|stochastic"),
    ("Média-alta: analisa processos ou artefatos de desenvolvimento com aderência prática ao tema.", "jira|github|requirements engineering|agile|devops"),
]
RELEVANCE_ELSE = "Média: relação indireta com a SLR, mais útil como contexto, método adjacente ou estudo complementar."
EVIDENCE = [
    ("Estudo empírico com dados reais.", "case study|real project|industrial|open-source projects|jira repositories"),
    ("Avaliação experimental.", "experiment|evaluation|user evaluation|benchmark"),
    ("Simulação computacional.", "simulation|monte carlo"),
    ("Proposta metodológica com evidência limitada.", "framework|model|methodology|approach"),
]
EVIDENCE_ELSE = "Tipo de evidência indefinido a partir da extração automática."
TECHNIQUE = [
    ("Mineração de processos.", "process mining|conformance|process discovery"),
    ("Cadeia de Markov.", "markov"),
    ("Rede de Petri estocástica.", "petri net"),
    ("Simulação.", "simulation|monte carlo"),
    ("IA/NLP/aprendizado de máquina.", "machine learning|reinforcement learning|ai|nlp|ontology"),
]
TECHNIQUE_ELSE = "Técnica principal não identificada automaticamente."
METHODS = [
    ("mineração de processos", "process mining|conformance|event log"),
    ("simulação", "simulation|monte carlo"),
    ("rede de Petri", "petri net"),
    ("cadeia de Markov", "markov"),
    ("apoio de IA/NLP/ontologia", "ontology|nlp|ai|machine learning"),
    ("estudo de caso", "case study"),
    ("proposta de framework/modelo", "framework|approach|methodology|model"),
]
METHODS_ELSE = "Método não identificado com clareza no texto extraído; requer leitura manual do artigo."
LIMITS = [
    ("escopo empírico possivelmente restrito", "case study|pilot|single|one project|small software development organization"),
    ("dependência de modelagem e premissas do autor", "simulation|model|ontology|framework"),
    ("ameaça de generalização para contexto industrial", "students|novice developers"),
    ("forte dependência da qualidade e cobertura dos logs/dados", "jira|github|version control|ide logging"),
]
LIMITS_ELSE = "Limitações não ficaram explícitas no texto extraído; convém validar na leitura completa."
CONTEXTS = [
    ("engenharia de requisitos", "requirements|requirement engineering"),
    ("desenvolvimento/codificação", "coding|commit|pull request|repository|refactoring"),
    ("qualidade e testes", "test|bug|defect|review|quality"),
    ("entrega e DevOps", "ci/cd|continuous integration|continuous delivery|devops|build|release|deployment"),
    ("contexto aplicado específico", "multidisciplinary|healthcare|microservices|open source|opensource"),
]
CONTEXTS_ELSE = "Contexto de processo de software não identificado com clareza na extração automática."
DATA_SOURCES = [
    ("issue tracker", "jira|issue|bugzilla|github issues"),
    ("repositório/VCS", "github|git|svn|repository|commit|version control"),
    ("pipeline CI/CD", "ci/cd|jenkins|github actions|build pipeline|continuous integration|continuous delivery"),
    ("logs de IDE", "ide|fluorite|eclipse plug-in|eclipse plugin"),
    ("percepção de usuários", "survey|questionnaire|user perceptions"),
]
DATA_SOURCES_ELSE = "Fonte dos dados não identificada com clareza na extração automática."
QUESTIONS = [
    ("RQ1", "requirements|coding|pull request|ci/cd|devops|software process|repository"),
    ("RQ2", "process mining|process discovery|conformance|markov|petri net|simulation|forecast|prediction"),
    ("RQ3", "integration|framework|pipeline|digital twin|what-if|stochastic conformance"),
]
PHASES = [
    ("Requisitos", "requirements|requirement engineering"),
    ("Design/Arquitetura", "design|architecture|microservices decomposition"),
    ("Desenvolvimento", "coding|commit|pull request|github|repository|refactoring|version control"),
    ("Qualidade/Testes", "test|bug|defect|review|quality"),
    ("Entrega/DevOps", "ci/cd|continuous integration|continuous delivery|devops|build|release|deployment"),
]
CRITERIA = [
    ("IC4a", MINING),
    ("IC4b", STOCHASTIC),
    ("IC4c", "forecast|prediction|remaining time|lead time|risk|duration prediction"),
    ("IC4d", "github|jira|repository|version control|commit|pull request|ci/cd"),
]
REASONS = {
    "incluir": "Alinha-se ao escopo da SLR por combinar contexto de desenvolvimento de software com técnica de processo, mineração ou modelagem estocástica.",
    "talvez": "Relaciona-se a software, mas a técnica principal extraída não evidencia com clareza mineração de processos ou modelagem estocástica.",
    "excluir": "A extração automática não mostrou aderência suficiente ao recorte de processo de software e técnicas-alvo da SLR.",
}
VERDICT = [("alta", "process mining|event log|conformance|simulation|markov|petri net"), ("média-alta", "software process|agile|devops|github|jira")]
STRENGTH = [
    ("Traz validação empírica", "case study|experiment|evaluation|monte carlo|dataset"),
    ("Propõe método reutilizável", "framework|model|approach|methodology"),
    ("Inclui componente analítico avançado", "ontology|ai|machine learning|reinforcement learning"),
]
STRENGTH_ELSE = "Tem valor mais conceitual do que operacional"
RESULT_HEADINGS = ("results", "findings", "evaluation", "experimental results", "experiments and results", "case study", "discussion", "conclusion")
RESULT_TERMS = "result|find|show|indicate|improv|effect"
COVER_PAGES = ("university", "universit", "institute", "faculty", "chapter ", "table of contents", "copyright", "issn", "isbn", "vol.", "proceedings")
QUALITY = {
    "qa2": "software|github|jira|devops|repository|software process|ci/cd",
    "qa3": "event log|svn|git|github|jira|issue|repository|pipeline",
    "qa4": "process mining|conformance|markov|petri|simulation|stochastic",
    "qa7": "github|open source|open-source|jira repositories|python enhancement|nasa",
    "qa8": "fitness|precision|generalization|correctness|usefulness|understandability",
}
QA_NOTE = "QA inferido automaticamente a partir de screening FT e enriquecimento PDF v4."

# How the lines begin that end a title and an abstract, and the numbers of sections.
TITLE_ENDS = ("abstract", "digital object identifier", "received ", "index terms", "email", "corresponding author")
ABSTRACT_ENDS = ("index terms", "keyword", "keywords", "introduction")
FIRST_NUMBERS = ("i. ", "1. ")
SECTION_NUMBER = r"^(?:[IVXLCivxlc]+\.|[0-9]+(?:\.[0-9]+)*)\s+"

#: All terms of the rules of a profile, each once: plain text, no patterns.
_RULES = [RELEVANCE, EVIDENCE, TECHNIQUE, METHODS, LIMITS, CONTEXTS, DATA_SOURCES, QUESTIONS, PHASES, CRITERIA, VERDICT, STRENGTH]
_TERMS = sorted({x for p in [MINING, STOCHASTIC, SOFTWARE, SOFTWARE_STRICT, *(p for rules in _RULES for _, p in rules)] for x in p.split("|")})


def _sentence(found: Column, sep: str, otherwise: str) -> Column:
    """Labels as one sentence: a capital first, small letters after it."""
    joined = F.array_join(found, sep)
    return F.when(F.size(found) == 0, otherwise).otherwise(F.concat(F.upper(F.left(joined, F.lit(1))), F.lower(F.substring(joined, 2, 1 << 30)), F.lit(".")))


def _or_else(found: Column, otherwise: str) -> Column:
    return F.when(F.size(found) == 0, otherwise).otherwise(F.array_join(found, ", "))


def profile(df: DataFrame, *text_columns: str) -> DataFrame:
    """Adds relevance, method, evidence, limitations, context, data_source, technique, decision, reason,
    questions, criteria, phases, level, priority and assessment. Null texts count as empty."""
    base = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in text_columns)))
    df = df.withColumn("_base", base)
    # every term is looked for once, whatever number of rules name it; the rules read the answers
    df = df.withColumn("_has", F.array(*(F.contains("_base", F.lit(x)) for x in _TERMS)))
    has = lambda pattern: reduce(lambda a, b: a | b, [F.get("_has", F.lit(_TERMS.index(x))) for x in pattern.split("|")])
    mining, stochastic = has(MINING), has(STOCHASTIC)
    df = df.withColumns(
        {
            "relevance": first_match(has, RELEVANCE, RELEVANCE_ELSE),
            "method": _sentence(all_matches(has, METHODS), ", ", METHODS_ELSE),
            "evidence": first_match(has, EVIDENCE, EVIDENCE_ELSE),
            "limitations": _sentence(all_matches(has, LIMITS), "; ", LIMITS_ELSE),
            "context": _sentence(all_matches(has, CONTEXTS), ", ", CONTEXTS_ELSE),
            "data_source": _sentence(all_matches(has, DATA_SOURCES), ", ", DATA_SOURCES_ELSE),
            "technique": first_match(has, TECHNIQUE, TECHNIQUE_ELSE),
            "decision": F.when(~has(SOFTWARE), "excluir").when(mining | stochastic, "incluir").otherwise("talvez"),
            "questions": _or_else(all_matches(has, QUESTIONS), "RQ1"),
            "phases": _or_else(all_matches(has, PHASES), "Não definido"),
            "_ics": all_matches(has, CRITERIA),
            "level": F.when(mining & has("markov") & has("simulation|monte carlo") & has("machine learning|reinforcement learning|ai|nlp"), "L3")
            .when(mining & has("markov|petri net|simulation|monte carlo"), "L2")
            .when(mining | has("markov|petri net|simulation|monte carlo"), "L1")
            .otherwise("L0"),
            "assessment": F.concat(F.lit("Relevância "), first_match(has, VERDICT, "média"), F.lit(" para a revisão. "), first_match(has, STRENGTH, STRENGTH_ELSE), F.lit(".")),
        }
    )
    none = F.size("_ics") == 0
    out = F.when((F.col("decision") == "excluir") & ~has(SOFTWARE_STRICT), "EC1").when((F.col("decision") == "excluir") & none, "EC3").when((F.col("decision") == "talvez") & none, "EC3?")
    high = F.col("relevance").startswith("Alta:") | F.col("relevance").startswith("Média-alta:")
    return df.withColumns(
        {
            "reason": F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv))[F.col("decision")],
            "criteria": _or_else(F.array_compact(F.concat("_ics", F.array(out))), "Requer decisão manual"),
            "priority": F.when((F.col("decision") == "incluir") & high, "Alta").when((F.col("decision") == "talvez") | (F.col("evidence") == EVIDENCE_ELSE), "Média").otherwise("Baixa"),
        }
    ).drop("_base", "_has", "_ics")


def infer_quality(df: DataFrame) -> DataFrame:
    """Fills null items qa1..qa8 by rule; blank qa_notes get a note, status "pendente" becomes "inferido".

    Reads title, abstract, rationale, results, evidence, data_source, technique, limitations, context.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    all_text = F.lower(F.concat_ws(" ", *map(text, ("title", "abstract", "rationale", "results", "evidence", "data_source", "technique", "context"))))
    stated = lambda c, unsaid: (text(c) != "") & ~F.contains(F.lower(text(c)), F.lit(unsaid))
    tests = {
        "qa1": (F.length(strip(text("abstract"))) > 80) | (F.length(strip(text("rationale"))) > 80),
        "qa2": contains_any(all_text, QUALITY["qa2"].split("|")),
        "qa3": stated("data_source", "não identificada") | contains_any(all_text, QUALITY["qa3"].split("|")),
        "qa4": stated("technique", "não identificada") | contains_any(all_text, QUALITY["qa4"].split("|")),
        "qa5": text("evidence").isin(EVIDENCE[0][0], EVIDENCE[1][0]),
        "qa6": stated("limitations", "não ficaram explícitas"),
        "qa7": contains_any(all_text, QUALITY["qa7"].split("|")),
        "qa8": contains_any(all_text, QUALITY["qa8"].split("|")),
    }
    notes = strip(F.coalesce("qa_notes", F.lit("")))
    status = F.when(F.col("qa_status") == "pendente", "inferido").otherwise(F.col("qa_status"))
    return df.withColumns({**{k: F.coalesce(k, t.cast("int")) for k, t in tests.items()}, "qa_notes": F.when(notes == "", QA_NOTE).otherwise(notes), "qa_status": status})


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda's outer expressions are computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def summarized(found: Column, most: int, chars: int) -> Column:
    """The first sentences, at most ``most``, that fit in ``chars`` characters; the first one always counts."""

    def add(acc, s):
        over = (acc["n"] > 0) & (acc["size"] + F.length(s) > chars)
        stop = acc["stop"] | over | (acc["n"] >= most)
        return F.struct(F.when(stop, acc["n"]).otherwise(acc["n"] + 1).alias("n"), F.when(stop, acc["size"]).otherwise(acc["size"] + F.length(s) + 1).alias("size"), stop.alias("stop"))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"), F.lit(False).alias("stop"))
    text = _let(found, lambda f: strip(F.left(F.array_join(F.slice(f, F.lit(1), F.aggregate(f, start, add)["n"]), " "), F.lit(chars))))
    return F.coalesce(text, F.lit(""))


def _split(text: Column) -> Column:
    return sentences(strip(F.regexp_replace(text, r"\s+", " ")))


def _opens(line: Column, term: str) -> Column:
    """A line in lower case begins with a term as whole words."""
    return F.startswith(line, F.lit(term)) & ~F.substring(line, len(term) + 1, 1).rlike(r"\w")


def _any(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _first_where(lines: Column, test, start: int = 0) -> Column:
    """The place (from 1) of the first line from ``start`` on (from 0) that passes a test; 0 without one."""
    return F.array_position(F.transform(lines, lambda x, i: (i >= start) & test(x)), True)


def _upto(lines: Column, stop: Column) -> Column:
    """The lines before a place (from 1); all of them for 0."""
    return F.when(stop > 0, F.slice(lines, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int"))).otherwise(lines)


def title_guess(text: Column) -> Column:
    """Of the first 20 lines, those before one that ends a title, as long as 180 characters are not passed, to 300.

    A title ends at a line with a mail address, at one of TITLE_ENDS, and, once it has begun, at a single
    word. Lines of less than five characters are left out.
    """
    lines = F.filter(F.transform(F.slice(F.split(text, r"\r\n|\n|\r"), 1, 20), strip), lambda x: x != "")
    ends = lambda x: F.contains(x, F.lit("@")) | _any([F.startswith(F.lower(x), F.lit(t)) for t in TITLE_ENDS])
    head = _let(lines, lambda x: _upto(x, _first_where(x, ends)))
    # from the first line that is long enough on, a single word ends it
    body = _let(head, lambda x: F.slice(x, F.greatest(_first_where(x, lambda y: F.length(y) >= 5), F.lit(1)).cast("int"), F.greatest(F.size(x), F.lit(0))))
    body = _let(body, lambda x: _upto(x, _first_where(x, lambda y: ~y.rlike(r"\s"), 1)))
    joined = F.aggregate(F.filter(body, lambda x: F.length(x) >= 5), F.lit(""), lambda title, x: F.when(F.length(title) > 180, title).when(title == "", x).otherwise(F.concat(title, F.lit(" "), x)))
    return F.coalesce(F.left(F.btrim(F.regexp_replace(joined, r"\s+", " "), F.lit(" ,-")), F.lit(300)), F.lit(""))


def abstract_section(text: Column) -> Column:
    """What follows the first word "abstract": up to a line that opens another part, else up to a last line that is a heading.

    A line opens another part if it begins with one of ABSTRACT_ENDS, or with the number of a first section and a word of
    one letter. A heading is a line of four letters, spaces and hyphens at least. Without either, or when all
    that is found sums up to 80 characters or less, it is empty.
    """
    rest = F.ltrim(F.get(F.split(text, r"(?i)\babstract\b", 2), F.lit(1)), F.lit(SPACE + "—:-"))
    lines = F.transform(F.split(rest, "\n"), lambda x: F.rtrim(F.ltrim(x, F.lit(SPACE)), F.lit("\r")))

    def opens(line):
        low = F.lower(line)
        numbered = _any([F.startswith(low, F.lit(n)) for n in FIRST_NUMBERS]) & low.rlike(r"^\S+\s+[a-z]\b")
        return _any([_opens(low, t) for t in ABSTRACT_ENDS]) | numbered

    heading = lambda x: strip(F.try_element_at(x, F.lit(-1))).rlike("^[A-Za-z][A-Za-z -]{3,}$")
    found = [
        _let(lines, lambda x: _let(_first_where(x, opens, 1), lambda at: F.when(at > 0, F.array_join(_upto(x, at), "\n")))),
        _let(F.filter(lines, lambda x: strip(x) != ""), lambda x: F.when((F.size(x) > 1) & heading(x), F.array_join(F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), "\n"))),
    ]
    short = [_let(summarized(_split(x), 5, 1800), lambda y: F.when(F.length(y) > 80, y)) for x in found]
    return F.coalesce(*short, F.lit(""))


def named_section(text: Column, heading: str) -> Column:
    """The text under a heading, numbered or not, to the next heading or the end.

    Lines are scanned without blank ones. A heading is a line of three letters, spaces and hyphens at least that is
    not the last one; the line under the heading asked for is never one.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    bare = lambda x: strip(F.regexp_replace(x, SECTION_NUMBER, ""))
    asked = lambda x: _let(F.size(x) - 1, lambda last: F.array_position(F.transform(x, lambda y, i: (i < last) & (F.lower(bare(y)) == heading)), True))
    # what follows the heading; empty without it
    under = _let(lines, lambda x: _let(asked(x).cast("int"), lambda at: F.when(at > 0, F.slice(x, at + 1, F.size(x))).otherwise(F.slice(x, F.lit(1), F.lit(0)))))
    ends = lambda x: _let(F.size(x) - 1, lambda last: F.array_position(F.transform(x, lambda y, i: (i > 0) & (i < last) & bare(y).rlike("^[A-Za-z][A-Za-z -]{2,}$")), True))
    body = _let(under, lambda x: _upto(x, ends(x)))
    return F.coalesce(summarized(_split(F.array_join(body, "\n")), 4, 1400), F.lit(""))


def result_sentences(text: Column) -> Column:
    return F.filter(_split(text), lambda s: F.lower(s).rlike(RESULT_TERMS))


def results_of(text: Column, abstract: Column) -> Column:
    """Result sentences of the abstract given, else of the one in the text, else a results section, else of the text."""
    hits = lambda x, most, chars: _let(summarized(result_sentences(x), most, chars), lambda y: F.nullif(y, F.lit("")))
    long = lambda h: F.when(F.contains(F.lower(text), F.lit(h)), _let(named_section(text, h), lambda y: F.when(F.length(y) > 80, y)))
    return F.coalesce(hits(abstract, 3, 900), hits(abstract_section(text), 3, 900), *map(long, RESULT_HEADINGS), hits(text, 4, 1000), F.lit(""))


def abstract_proxy(text: Column) -> Column:
    """The first 500 characters of a text that does not start as a cover page; empty below 80."""
    plain = strip(F.regexp_replace(text, r"\s+", " "))
    cover = reduce(lambda a, b: a | b, [F.startswith(F.lower(plain), F.lit(p)) for p in COVER_PAGES])
    start = strip(F.left(plain, F.lit(500)))
    return F.when(~cover & (F.length(start) >= 80), start).otherwise("")


def extracted(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds title_guess, abstract_found, results_found of text extracted from a file, and its cleaned length."""
    return df.withColumn("_clean", clean_extracted(F.coalesce(text, F.lit("")))).withColumns(
        {"title_guess": title_guess(F.col("_clean")), "abstract_found": abstract_section(F.col("_clean")), "results_found": results_of(F.col("_clean"), F.lit("")), "clean_length": F.length("_clean")}
    ).drop("_clean")
