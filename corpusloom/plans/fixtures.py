"""Small literal tables, as rows for Spark and as VALUES for SQL."""

from __future__ import annotations

from dataclasses import dataclass


def _literal(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return f"{v}::bigint" if isinstance(v, int) else f"{v}::double"


@dataclass(frozen=True)
class Fixture:
    schema: str
    rows: list[tuple]

    @property
    def sql(self) -> str:
        names = ", ".join(c.split()[0] for c in self.schema.split(","))
        return f"(select * from (values {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in self.rows)}) v({names}))"


SECTIONS = Fixture(
    "matter long, section long, doc_type string, text string",
    [
        (1, 1, "contract", "Contrat de travail entre Mme Salma Idrissi et la société Atlas Conseil SARL. Salaire mensuel 9000 MAD."),
        (1, 2, "letter", "Objet: licenciement. Notice period is 1 month. Your employment was terminated effective from 2024-03-01."),
        (1, 3, "letter", "The notice period is 3 months; the employer must pay the balance. Notice given on 12/02/2024."),
        (2, 4, "payslip", "Bulletin de paie. Salaire brut 8000. Cotisations 400."),
        (2, 5, "correspondence", "Courriel du 5.6.2023: merci."),
        (3, 6, "other", "mr omar alaoui wrote to acme services llc. compensation will be paid."),
    ],
)
MESSAGES = Fixture("role string, text string", [("user", "Bonjour !"), ("user", "مرحبا بكم"), ("user", "שלום לך"), ("user", "Hello there"), ("user", "Où est l'été ?"), ("user", ""), ("user", "hello, I have a question about notice")])
MOVES = Fixture(
    "id long, machine string, before string, after string, reviewer string",
    [
        (1, "parse_status", "pending", "parsed", None), (2, "parse_status", "parsed", "pending", None), (3, "chunk", "embedded", "indexed", None), (4, "chunk", "indexed", "indexed", None),
        (5, "draft", "draft", "lawyer_reviewed", None), (6, "draft", "draft", "acknowledged", None), (7, "draft", "draft", "lawyer_reviewed", "Me Idrissi"), (8, "draft", "acknowledged", "lawyer_reviewed", "  "),
        (9, "draft", "lawyer_reviewed", "draft", None), (10, "draft", "acknowledged", "draft", None), (11, "parse_status", "failed", "pending", None), (12, "extract_status", "quarantined", "extracted", None),
        (13, "chunk", "embedded", "pending", None), (14, "chunk", "indexed", "failed", None), (15, "embed_status", "pending", "quarantined", None), (16, "nothing", "a", "b", None),
        (17, "index_status", "indexed", "failed", None), (18, "draft", "draft", "draft", None), (19, "embed_status", "failed", "embedded", None), (20, "draft", "draft", "sent", "x"), (21, "chunk", "pending", "indexed", None),
    ],
)
PATHS = Fixture("id long, path string", [(1, "/files/loi 65.99.pdf#toolbar=0"), (2, "http://x.example/a b"), (3, "قانون/é.pdf"), (4, " a/b?c=d&e:f "), (5, "")])
UPLOADS = Fixture("id long, name string, size long", [(1, "a/b.PDF", 10), (2, "c.exe", 10), (3, "d.md", 20_000_001), (4, ".txt", 1), (5, "e", 1), (6, "f.tar.docx", 20_000_000)])
FILES = Fixture(
    "id long, status string, index_status string, sha string, reason string",
    [(1, "pending", "pending", None, None), (2, "extracted", "pending", "", None), (3, "extracted", "pending", "ab", None), (4, "quarantined", "pending", None, "worker-crash: 9"), (5, "quarantined", "pending", None, "duplicate-of: 3"), (6, "failed", "indexed", None, None), (7, "failed", "pending", "cd", None)],
)
PAGES = Fixture("doc long, page_no long, page_start long, page_end long, confidence double, review boolean", [(1, 1, 0, 100, 0.9, False), (1, 2, 101, 250, None, True), (1, 3, 251, 400, 0.5, False), (2, 1, 0, 80, None, False)])
SPANS = Fixture("doc long, pos long, until long", [(1, 0, 50), (1, 90, 180), (1, 251, 399), (2, 10, 20), (2, 79, 200)])
HEADINGS = Fixture(
    "doc long, line long, book string, part string, chapter string",
    [(1, 1, "I", None, None), (1, 2, None, "A", None), (1, 3, None, None, "x"), (1, 4, None, None, None), (1, 5, None, "B", None), (1, 6, None, None, None), (1, 7, "II", None, None), (1, 8, None, None, "y"), (2, 1, None, None, "z"), (2, 2, None, "C", None)],
)
EDGES = Fixture("src long, dst long", [(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (3, 568), (568, 9), (4, 7)])
PRIVACY = Fixture("id long, text string, external boolean, mode string, consent boolean", [(1, "plain", True, "strict", False), (2, "see [matter: doc 1]", False, "strict", False), (3, "see [matter: doc 1]", True, "strict", True), (4, "¶ 4", True, "ask", False), (5, "¶ 4", True, "ask", True)])
TOOL_TEXTS = Fixture("id long, text string", [(1, '{"tool": "search_matter", "query": "notice"}'), (2, 'I will call {"tool": "search_authority", "query": "article 7"} now'), (3, '{"tool": "unknown", "query": "x"}'), (4, "OUT_OF_SCOPE"), (5, "IN_SCOPE or OUT_OF_SCOPE"), (6, '{"tool": ')])
CITATIONS = Fixture("seq long, document_id long, page long, s long, e long", [(1, 7, 1, 0, 40), (2, 7, 1, 0, 40), (3, 7, 2, 5, 9), (4, 8, 1, 0, 40)])
AUTHORITY_FILES = Fixture(
    "filename string, folder string",
    [
        ("ظهير شريف رقم 1.11.91 صادر في 27 من شعبان 1432 (29 يوليو 2011).pdf", ""),
        ("قانون رقم 65.99 المتعلق بمدونة الشغل.pdf", "المادة المدنية"),
        ("Constitution 2011 version française.pdf", ""),
        ("notes diverses.pdf", "المادة التجارية"),
        ("مرسوم رقم 2.04.422 بتاريخ 29 ديسمبر 2004.PDF", "المادة العقارية"),
    ],
)
PAGED = Fixture(
    "doc long, page_no long, text string, confidence double, review boolean",
    [
        (1, 1, "Préambule du texte\nArticle 1\nPremier corps.\nsuite", 0.9, False),
        (1, 2, "Titre II\nArticle 2\nSecond corps.", None, True),
        (2, 1, "ظهير شريف رقم 1\nالباب الأول\nالفصل 1\nنص أول\n5 الفصل\nنص ثان", 0.7, False),
        (3, 1, "plain page without items", None, False),
        (3, 2, "   \n ", None, False),
    ],
)
#: Statutes: an act over two pages, a decree, a decision, numbered items in both orders, an act without items, blank pages, lines after a header.
STATUTES = Fixture(
    "doc long, page_no long, text string, path string",
    [
        (-1, 1, "ظهير شريف رقم 1.11.151 صادر في 16 من رمضان 1432 (17 أغسطس 2011)\nبتنفيذ القانون رقم 36.21 المتعلق بالحالة المدنية\nالكتاب الأول: أحكام عامة\nالمادة 1 - نطاق التطبيق\nتسري أحكام هذا القانون على جميع المغاربة.\n", "/x/المادة المدنية/doc.pdf"),
        (-1, 2, "الباب الثاني: التسجيل\nالمادة 2 - واجب التصريح\nيجب التصريح بالولادات خلال ثلاثين يوما.\n", "/x/المادة المدنية/doc.pdf"),
        (-2, 3, "مرسوم رقم 2.22.690 بتطبيق القانون رقم 36.21 المتعلق بالحالة المدنية\nالمادة 1 - كيفيات التطبيق\nتحدد بنص تنظيمي كيفيات تطبيق أحكام القانون المذكور.\n", "/x/المادة المدنية/doc.pdf"),
        (-3, 5, "قرار لوزير العدل بتحديد استمارات التصريح بالتقييد في السجل التجاري\nالمادة 1 - الاستمارات\nتحدد استمارات التصريح بقرار مشترك.\nالمادة 2 - النشر\nينشر هذا القرار بالجريدة الرسمية.\n", "/x/مادة المعاملات الالكترونية/doc.pdf"),
        (-4, 1, "الكتاب الأول: الالتزامات\nالفصل 1 - مبدأ سلطان الإرادة\nتنشأ الالتزامات عن الاتفاقات والتصريحات.\nالفصل 2 - الأهلية\nيشترط في الملتزم أن يكون متمتعا بالأهلية.\n", "/x/المادة المدنية/doc.pdf"),
        (-5, 1, "   \n ", "/x/y/doc.pdf"),
        (-5, 2, "", "/x/y/doc.pdf"),
        (-6, 4, "مذكرة تفسيرية بدون ترقيم للمواد.", None),
        (-7, 1, "Préambule du texte\n\nTitre II\nArticle 1\nPremier corps.\nsuite", "/x/مادة الوظيفة العمومية/a.pdf"),
        (-7, 2, "Titre III\nالفصل الأول\nArticle ٢\nSecond corps.\n الفصل 3 dit\n5 الفصل\nfin\nالكتاب الثاني\n7 الفصل", "/x/مادة الوظيفة العمومية/a.pdf"),
        (-8, 1, "Avant\nقانون رقم 1\n\nالمتعلق بكذا\nبشأن كذا\nالمادة 9\nنص\nالصادر بعد ذلك", "a.pdf"),
        (-9, 1, "Article 3\nقانون رقم 2\nالمتعلق بكذا", "/x/المادة الجنائية/b.pdf"),
        (-10, 1, "دستور\nالمتعلق بكذا\nحاشية\nالمتعلق بغيره\nالمادة 1", "/x/المادة الجنائية/b.pdf"),
    ],
)
#: Case files: a termination letter, two notice periods and a phrase across sections, a flagged section, one name in two matters, lower case, no sections.
CASES = Fixture(
    "matter long, seq long, document_id long, page long, s long, e long, title string, text string, needs_review boolean",
    [
        (-1, 0, 1, 1, 0, 90, "Letter", "Mme Salma Berrada, ATLAS TEXTILES SARL: your employment is terminated effective 2024-03-15. Notice period is 1 month.", False),
        (-2, 0, 2, 1, 0, 40, "Contract", "The notice period is 1 month; pay. Mme Salma Berrada signed.", False),
        (-2, 1, 3, 2, 5, 60, "Addendum", "The notice period is 3 months. Also 1 month. Acme Services LLC shall pay 900 MAD.", False),
        (-2, 2, 4, 1, 0, 30, "Mail", "Nous devons donner un avis: notice given on 12/02/2024", True),
        (-3, 0, 5, 1, 0, 20, "A", "no word here, only notice", False),
        (-3, 1, 6, 1, 0, 20, "B", "period ends on 2024-01-01, effet à partir du 5.6.2023; M. Omar Alaoui", False),
        (-4, 0, 7, 1, 0, 20, None, "mr omar alaoui wrote to acme services llc. compensation will be paid. fired!", False),
        (-4, 1, 8, 1, 0, 20, "Null", None, None),
    ],
)
FILED = Fixture("matter long, document_id long, doc_type string", [(-1, 1, "letter"), (-2, 2, "contract"), (-2, 3, "letter"), (-2, 4, "correspondence"), (-2, 9, "payslip"), (-2, 10, "payslip"), (-2, 11, "payslip"), (-3, 5, "payslip"), (-6, 12, "contract")])
PASSAGES = Fixture(
    "matter long, seq long, domain string, source string, version string, edition string, article_or_section string",
    [(-1, 0, "authority", "Code du travail", "65.99", "ar", "Article 43"), (-1, 1, None, "Code du travail ", "65.99", "fr", "Article 43"), (-1, 2, "matter", "x", "1", "ar", "Article 1"), (-1, 3, "authority", " ", "1", "ar", "Article 1"), (-2, 0, "authority", "DOC", None, None, "Fasl 230")],
)
