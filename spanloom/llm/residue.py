"""Template residue and error-page text: a multi-pattern automaton over whole texts.

One automaton holds the words and phrases by which messages of error pages and crashed programs,
script notices and stand-in sentences are known, in several languages, and the openings of template
slots. A text without any of them, as almost all are, is done in one pass.

Where it is hit, the hit's segment is looked at: the sentence, line, tag or bracket that it stands
in. A message says little beside itself, prose that uses its words does. So a segment counts if the
words that such messages are made of cover enough of its letters (COVERED), small words left out, and
if they tell both a state (not found, denied, to be inserted) and what is in it (page, access, text).
Forms that no prose has - slots, traces, runs of filler - count wherever they stand. What prose
quotes is passed over: there such things are named rather than left over.

A text counts by a single hit, however long it is: a document is wanted that holds residue
anywhere. The share of the text that hits cover comes out beside it, and `residue` takes the least
share that counts as a parameter.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: The share of a segment's letters that message words must cover: of messages and stand-ins, of script notices.
COVERED, COVERED_SCRIPT = 0.8, 0.5

# Word lists, lower case. An entry matches from the beginning of a word on (in Chinese, Greek and
# Hebrew anywhere); with a mark ! it is enough by itself if it fills its segment.
#: What has happened, or is asked for.
STATES = """
en: not found|can't find|cannot find|can not find|couldn't find|could not find|unable to find|be found|nothing was found|be reached|unreachable|denied|not authorized|unauthorized|forbidden|refused|rejected|expired|timed out|timeout|time-out|too long to respond|unavailable!|not available|no longer available|doesn't exist|does not exist|no longer exist|maintenance!|failed|failure|error|went wrong!|try again|too many|rate limit!|blocked|not working|isn't working|be processed|be loaded|be displayed|be completed|invalid|moved|bad gateway!|overloaded|unable to|back soon!|back shortly!|banned|don't have permission|do not have permission|retry|reload|sign in again|log in again|unexpected
de: nicht gefunden|nicht finden|verweigert|nicht erreichbar|nicht verfügbar|existiert nicht|existiert leider nicht|nicht mehr|fehlgeschlagen|gescheitert|abgelaufen|wartung|fehler|ist aufgetreten|erneut versuchen!|noch einmal!|später erneut!|versuchen sie|zu viele|keine berechtigung|gesperrt|blockiert|überlastet|serverfehler!|zeitüberschreitung!|warten|erneut an!
fr: introuvable|non trouvé|pas trouvé|pas été trouvé|ne trouvons|refusé|pas autorisé|non autorisé|n'existe pas|n'existe plus|indisponible|erreur|est survenue|réessayer|réessayez|expiré|maintenance!|trop de|impossible de|échoué|échec|interdit|bloqué|surchargé|reconnecter!|patienter
es: no encontrad|no se encontr|no se ha encontrado|no pudimos encontrar|no podemos encontrar|denegado|no tiene permiso|no está autorizado|no existe|ya no existe|no disponible|no está disponible|error|se ha producido|inténtelo|inténtalo|caducado|expirado|mantenimiento!|demasiad|no se pudo|no se puede|prohibido|bloquead|falló|fallido|de nuevo|más tarde!|espere
it: non trovat|non è stata trovata|non riusciamo a trovare|impossibile|negato|non hai i permessi|non autorizzat|non esiste|non disponibile|non è al momento|non è disponibile|errore|si è verificato|riprova|riprovare|scadut|manutenzione!|troppe|troppi|vietato|bloccat|fallit|torneremo|attendi
pt: não encontrad|não foi encontrad|não conseguimos encontrar|negado|não tem permissão|não autorizad|não existe|indisponível|não está disponível|erro|ocorreu um|tente novamente|expirou|expirad|manutenção!|muitas|demasiad|não foi possível|proibido|bloquead|falhou|falha|voltaremos|aguarde|novamente
nl: niet gevonden|niet vinden|geweigerd|geen toestemming|niet bevoegd|bestaat niet|niet beschikbaar|fout|is opgetreden|probeer|opnieuw|verlopen|onderhoud!|te veel|geen verbinding|mislukt|verboden|geblokkeerd|serverfout!
el: δεν βρέθηκε|σφάλμα|απαγορεύεται|δεν υπάρχει|προσπαθήστε ξανά|μη διαθέσιμη|έληξε
he: לא נמצא|שגיאה|הגישה נדחתה|אינו זמין|נסה שוב|פג תוקף
zh: 未找到|找不到|不存在|没有权限|无权|错误!|不可用|稍后再试!|稍后重试!|过于频繁|繁忙|失败|已过期|过期|维护中|维护|拒绝|禁止|超时|重新登录!|出错|异常
"""
#: What it has happened to.
THINGS = """
en: page|site|website|server|service|request|session|database|data base|connection|connect|access|url|link|address|resource|file|content|article|post|document|chapter|passage|entry|index|query|gateway|upstream|response|host|network|domain|login|account|ip|loading|load|browser|application|app|key|object|code|incident|permission
de: seite|website|webseite|server|dienst|anfrage|sitzung|datenbank|verbindung|zugriff|zugang|adresse|datei|inhalt|http|anwendung|konto|fehler
fr: page|site|serveur|service|requête|session|base de données|connexion|connecter|accès|adresse|fichier|contenu|interne|erreur
es: página|pagina|sitio|servidor|servicio|solicitud|sesión|base de datos|conexión|conectar|acceso|dirección|archivo|contenido|interno|error
it: pagina|sito|server|servizio|richiest|sessione|database|connessione|connetter|accesso|indirizzo|file|contenuto|interno|errore
pt: página|site|sítio|servidor|serviço|solicitaç|pedido|sessão|banco de dados|base de dados|conexão|conectar|acesso|acessar|endereço|arquivo|conteúdo|interno|erro
nl: pagina|site|website|server|dienst|verzoek|sessie|database|verbinding|toegang|adres|bestand|inhoud|intern|fout
el: σελίδα|διακομιστή|πρόσβαση|αίτημα|συνεδρία
he: הדף|העמוד|השרת|הבקשה|השירות
zh: 页面|网页|网站|服务器|服务|请求|会话|数据库|访问|连接|系统|网络|内部|加载
"""
#: What else such messages say.
BESIDES = """
en: sorry|oops|something|please|later|looking|looks like|look like|location|requested|return|back|home|contact|administrator|owner|support|view|see|continue|again|soon|check|spelling|temporarily|currently|performing|scheduled|http|status|error|internal|unexpected|condition|encountered|occurred|seconds|minutes|moment|establishing|contacting|specified|parameter|resource|while|list|side|right now|right|working|perform|complet|method|allowed|number|ref|previous|refresh|tak|message|long
de: leider|bitte|später|erneut|versuchen|gesucht|suchen|angefordert|aufrufen|aufzurufen|vorübergehend|wegen|arbeiten|interner|intern|moment|http|melden|entschuldigung|zurück|startseite|administrator|ist ein|gefunden|mehr|wartungsarbeiten|zeit
fr: désolé|veuillez|merci|ultérieurement|plus tard|recherch|cherch|demandé|consulter|temporairement|cours|interne|instants|quelques|retour|accueil|http|autorisé|momentanément
es: lo sentimos|sentimos|por favor|más tarde|busca|solicitad|ver|temporalmente|interno|momento|vuelva|inicio|http|inténte|otra vez|nuevo|encuentra|inicie|sesión|encontrar
it: spiacenti|per favore|più tardi|cerchi|cercat|richiest|visualizzare|temporaneamente|momento|interno|qualche|istante|presto|online|home|http|effettua|nuovo|trovata|stata
pt: desculpe|por favor|mais tarde|procura|solicitad|acessar|ver|temporariamente|interno|momento|instante|breve|faça|login|http|início|conectar
nl: sorry|helaas|alstublieft|later|zoekt|zocht|gevraagde|bekijken|tijdelijk|interne|even|wacht|log|http|terug|maken
el: παρακαλώ|αργότερα|που ζητήσατε
he: מצטערים|בבקשה|שביקשת
zh: 抱歉|对不起|请|您|的|此|你|正在|中|敬请谅解|刷新|重试|暂时|数据|稍后
"""
#: Notices about scripts: what is said of javascript, or of scripting in a browser.
SCRIPT_STATES = """
en: enable|require|disabled|turned off|turned on|turn on|turn it on|switched off|switch it on|support|allow|necessary|need|without|works best|must be|activate|not running|blocked
de: aktivier|benötig|erforder|deaktiviert|ausgeschaltet|eingeschaltet|unterstütz|einschalten|ohne
fr: activer|activez|nécessit|désactivé|prend pas en charge|requiert|requis|sans
es: active|activar|habilit|requiere|desactivado|deshabilitado|no admite|no soporta|necesit
it: abilit|attiv|richied|disabilitat|disattivat|non supporta|necessari
pt: ative|ativar|habilit|requer|desativad|desabilitad|não suporta|necessári|precis
nl: schakel|vereist|uitgeschakeld|ingeschakeld|ondersteun|nodig
el: ενεργοποι|απαιτεί|απενεργοποι
he: הפעל|דורש|מושבת
zh: 启用|需要|不支持|禁用|开启|打开|支持
"""
SCRIPTS = "javascript|java script|active scripting|scripting|scripts in your browser|allow scripts|enable scripts|enable js|js is|with js|js and"
SCRIPT_BESIDES = "browser|navegador|navigateur|page|seite|pagina|página|site|website|web|app|anwendung|application|please|bitte|veuillez|por favor|per favore|run|view|see|display|load|continue|continuar|continuer|settings|setting|functionality|full|mode|javascript|js|afficher|weiter|utiliser|nutzen|to use|work|function|fonction|funcion|bekijken|gebruiken|reader|浏览器|请|网站|您|设置|继续|浏览|运行|正常"
#: Stand-ins: what is to be done, or still to come.
FILLER_STATES = """
en: placeholder!|dummy|sample text!|filler text!|goes here|text here|to follow|follows|coming soon|click to edit!|add your own|insert|type|add|enter|write|paste|replace|to be added|to be written|lorem ipsum!
de: blindtext!|platzhalter|hier steht|hier könnte ihr|folgt|einfügen|ersetzen|eingeben|fülltext!|mustertext!|beispieltext!|bald verfügbar
fr: provisoire|de remplissage!|à remplacer|à venir|insér|saisissez|factice|faux texte!|remplacer
es: de relleno!|de ejemplo!|sustituir|reemplazar|próximamente|escriba|insert|marcador de posición!|pendiente
it: segnaposto!|di esempio!|riempitivo!|in arrivo|inseri|sostituire|scrivi
pt: de preenchimento!|de exemplo!|em breve|insira|inserir|substituir|escreva|marcador
nl: voorbeeldtekst!|opvultekst!|plaatshouder|volgt|voeg|invoegen|vervangen|typ
el: κείμενο κράτησης!|εισάγετε
he: טקסט לדוגמה!|הכנס
zh: 占位!|示例文本!|填写|输入|插入|即将更新!|敬请期待
"""
FILLER_THINGS = """
en: text|content|copy|paragraph|description|summary|chapter|title|heading|commentary|comment|introduction|body|here|your own|caption|headline|subheading|article|name|note|passage|box|field
de: text|inhalt|titel|kommentar|einleitung|beschreibung|kapitel|absatz|hier|überschrift|name
fr: texte|contenu|titre|commentaire|introduction|description|chapitre|paragraphe|ici|nom
es: texto|contenido|título|titulo|comentario|introducción|descripción|capítulo|párrafo|aquí|aqui|publicar|nombre
it: testo|contenut|titolo|commento|introduzione|descrizione|capitolo|paragrafo|qui|nome
pt: texto|conteúdo|título|titulo|comentário|introdução|descrição|capítulo|parágrafo|aqui|nome
nl: tekst|inhoud|titel|commentaar|inleiding|beschrijving|hoofdstuk|hier|naam
el: κείμενο|τίτλο|εδώ
he: טקסט|כותרת|כאן
zh: 内容|文字|文本|此处|在此|标题|姓名|更新
"""
FILLER_BESIDES = "please|bitte|release|before|publish|real|replace|own|short|summary|the real article|ersetzen|stehen|steht|später|kürze|binnenkort|par le|antes|publicar|posición|definitive|version|attendant|en attendant|edit|add|type|esempio|ejemplo|exemplo|请|这是|更新"
#: Words too small to tell anything: they count neither for nor against a segment.
SMALL = """
en: a an the this that these those is are was were be been being am do does did has have had will would can could may might it its it's we you your yours our us i he she they their them his her of to in on at for from by with and or as if not no so there here which who what when then than any some for under
de: der die das den dem des ein eine einen einem einer dies diese dieser dieses diesem ist sind war waren wird werden wurde hat haben sie ihr ihre ihrem ihren wir uns unser es er in im an am auf für von vom zu zum zur mit und oder als wenn nicht kein keine um nur so bei
fr: le la les l un une des du de d ce cet cette ces est sont était a ont vous votre vos nous notre il elle on ne n pas plus en dans sur pour par avec et ou que qui qu à au aux s se si être
es: el la los las un una unos unas de del al este esta estos estas es son era ha han su sus nos nuestro usted se no ya en por para con y o que lo es le me
it: il lo la i gli le l un uno una di del della dei al alla da dal in nel nella su per con e o che non si è sono era ha hai hanno tuo tua il suo questo questa questi ti ci al
pt: o a os as um uma de do da dos das ao à este esta isto é são era tem seu sua você nós nosso se não em no na nos nas por para com e ou que
nl: de het een deze dit die dat is zijn was wordt worden heeft hebben u uw wij we ons onze je jouw er in op aan van voor met en of als niet geen om te kan moet al
el: ο η το οι τα του της των τον την σε στο στη και να για με από που δεν είναι
he: את של על לא זה זו הוא היא
"""

#: Enough wherever they stand.
CERTAIN = """
traceback (most recent call last)|uncaught exception|uncaught error|uncaught typeerror|unhandled exception|unhandled rejection
exception in thread|segmentation fault|core dumped|stack overflow error|nosuchkey|java.lang.|nullpointerexception|stack trace:
cannot get /|cannot post /|econnrefused|econnreset|etimedout|enotfound|mysql_fetch|mysqli_|expects parameter 1 to be
undefined index:|undefined variable:|undefined offset:|call to undefined function|goroutine 1 [|<noscript|was not found on this server
cannot read propert
"""
STOCK = "lorem ipsum|sed ut perspiciatis unde omnis|at vero eos et accusamus|nemo enim ipsam voluptatem"
#: Phrases of status codes, as the protocol names them.
REASONS = "bad request|unauthorized|payment required|forbidden|not found|method not allowed|not acceptable|request timeout|conflict|gone|payload too large|uri too long|too many requests|internal server error|not implemented|bad gateway|service unavailable|service temporarily unavailable|gateway timeout|gateway time-out"
#: What comes before a code, in several languages.
CODED = "http error|http status|http-fehler|http fehler|error code|status code|error|fehler|erreur|errore|erro|fout|σφάλμα|שגיאה|错误|http"

#: Words of the customary filler: a run of RUN of them, with RARE or more that ordinary Latin hardly has.
LATIN = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
LATIN_RARE = set("lorem ipsum amet consectetur adipiscing elit eiusmod incididunt aliqua minim nostrud ullamco laboris aliquip commodo irure reprehenderit cillum fugiat pariatur excepteur sint occaecat cupidatat proident culpa deserunt mollit laborum".split())
RUN, RARE = 5, 3

#: Where a slot can begin: what the automaton looks for before the forms are tried.
OPENINGS = ["{{", "{%", "#{", *("{" + c for c in "abcdefghijklmnopqrstuvwxyz0123456789"), "<%", "<?", "${", "%(", "@@", "__", "[[", "%s", "[object", "undefined", "null:null", "missing(", "tbd_", "[insert", "<insert", "[your", "goes here", "(todo", "todo:"]
SIGNED = ["$", "%"]
#: Where a trace or a program's own message can begin.
TRACES = ["error:", "exception:", "exception", "warning:", "notice:", "panic:", "err_", ".js:", ".ts:", ".py", ".java:", ".rb:", ".go:", ".php", '"error"', '"status"']
#: Where runs can begin: what their forms have two of, four of, and one of.
STARTS = ["bla", "test", "abc", "asd", "xxx", "lorem"]
_ABOUT = ["word", "words", "line", "lines", "some", "more", "text"]
PAIRS = [a + blank + b for a in _ABOUT for blank in " \n" for b in _ABOUT]
_NAMES = ["foo", "bar", "baz", "qux"]
KEYS = ["asdf", "qwer", "zxcv", "aaaa", "bbbb", "cccc", *(a + blank + b for a in _NAMES for blank in " \n\t" for b in _NAMES)]
#: Letters that patterns without case take for s and i, though they aren't these in lower case.
ODD = ["ſ", "ı"]
_NAME = r"[A-Za-z][\w.-]*"
# The forms of slots, directives and failed substitutions. Each ends with its closing mark.
SLOTS = rf"""
\{{\{{[^{{}}\n]+\}}\}}
\{{%-?\s*\w+[^%\n]*%\}}
<%[=-]?[^%\n<]*%>
<\?(?:=|php\b)[^?\n]*\?>
[$#]\{{\s*{_NAME}\s*\}}
%\({_NAME}\)[sdrif]
%s\s+%d:%d
%[A-Za-z][\w.-]+%
\$[A-Za-z][\w.-]+\$
@@[A-Za-z][\w.-]*@@
(?<!\w)__[A-Za-z][\w.-]*?__(?!\w)
\[\[\s*{_NAME}\s*\]\]
\bMISSING\({_NAME}\)
\bTBD_[A-Za-z][\w.-]*
\[(?i:insert)\s[^\[\]\n]+\]
<(?i:insert)\s[^<>\n]+>
\[(?i:your)\s[^\[\]\n]+\]
\[[^\[\]\n]+\s(?i:goes\ here)\]
\(TODO:?\s[^()\n]+\)
\bTODO:\s
\[object\ Object\]
\bundefined\s+(?:\d+|NaN|undefined):(?:NaN|undefined)
\bnull\s+null:null\b
\{{\d\}}(?=\s*\{{\d\}}|:\{{\d\}})
(?<![\w"{{$#]){{{_NAME[:-1]}+\}}(?!\}})
"""
# The forms of a program's own messages.
TRACE = r"""
(?<![a-z])(?!error|exception)[a-z_.]*[a-z](?:error|exception):\s
(?<![a-z])(?:fatal|parse|runtime)\s+error:
(?<![a-z])(?:warning|notice):\s+[\w:]+\(\)
(?<![a-z])panic:\s
\berr_[a-z_]{4,}
\bat\s[\w.$<>]+\s?\([\w./-]+:\d+(?::\d+)?\)
file\s"[^"\n]+",\sline\s\d+
\bin\s/[\w./-]+\.php(?::\d+|\son\sline\s\d+)
"error"\s*:\s*\{\s*"(?:code|message|status)"
"status"\s*:\s*[45]\d\d\b
"""
_CODE = "|".join(re.escape(x) for x in sorted(CODED.split("|"), key=len, reverse=True))
_REASON = "|".join(x.replace(" ", r"\s") for x in REASONS.split("|"))
PATTERNS = {
    "slot": re.compile("|".join(f"(?:{x})" for x in SLOTS.strip().split("\n"))),
    "trace": re.compile("|".join(f"(?:{x})" for x in TRACE.strip().split("\n")), re.I),
    "code": re.compile(rf"(?<!\w)(?:{_CODE})\W{{0,3}}(?:(?:code|status|no|nr)\W{{1,2}})?[45]\d\d\b|(?<![\w:.-])[45]\d\d\W{{1,3}}(?:{_REASON})(?!\w)", re.I),
    # the same word again and again, words about words, rows of the keyboard
    "run": re.compile(r"(?<!\w)(?:(?:blah?|test|abc|asdf?|x{3,}|lorem)\b\W{1,3}){2,}(?:blah?|test|abc|asdf?|x{2,}|lorem)(?!\w)", re.I),
    "about": re.compile(r"(?<!\w)(?:(?:words?|lines?|some|more|text)[ \n]){4,}(?:words?|lines?|some|more|text)(?!\w)", re.I),
    "keys": re.compile(
        r"(?<!\w)(?:asdf\w*|qwert?y?|zxcv\w*)(?!\w)|(?<!\w)(?:foo|bar|baz|qux)[ \n\t](?:foo|bar|baz|qux)(?!\w)|(?<!\w)(?:a{4}|b{4}|c{4})\s(?:b{4}|c{4}|d{4})", re.I
    ),
}
_MARKS = re.compile("“[^“”\n]+”|„[^„“”\n]+[“”]|«[^«»\n]+»")
_WORD = re.compile(r"[^\W\d_]+")
_TERM = re.compile(r"[^\W\d_]+(?:['-][^\W\d_]+)*")
_DATA = re.compile(r'^(?:[\W_]*<[^<>]*>)?[^\w"]*[\[{]\s*"|^\s*File "')
#: Where a segment ends: lines, tags, brackets, and ends of sentences.
_ENDS = re.compile(r"[\n\r<>\[\]|]|[.!?;](?=[\s\"')\]<]|$)|[。！？；]|\s[—–]\s")
#: Characters that are no text: they can stray into words.
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]")
_PICTURE = re.compile("[\U0001f000-\U0001faff☀-➿]")
_FOREIGN = re.compile(r"[^\x00-\x7f]+")
_SPLIT = re.compile(r"(?<=[^\W\d_])[\t\x0c](?=[^\W\d_])")
_WIDE = re.compile("[\u0370-\u03ff\u0590-\u05ff\u3400-\u9fff]")


def _entries(text: str) -> list[str]:
    """The entries of a word list, whatever the language."""
    return [x.strip() for line in text.strip().split("\n") for x in line.split(": ", 1)[-1].split("|")]


def _small() -> set[str]:
    return {x for line in SMALL.strip().split("\n") for x in line.split(": ", 1)[1].split()}


def _unquoted(text: str) -> str:
    """The text with what prose quotes blanked: spans between quotation marks that have words beside them.

    Straight marks count in lines that aren't data (JSON and the like); places keep their numbers.
    """
    if "“" in text or "„" in text or "«" in text:
        text = "\n".join(_kept(line, _MARKS.sub(lambda m: " " * len(m[0]), line)) for line in text.split("\n"))
    if '"' in text:
        text = "\n".join(line if '"' not in line or _DATA.search(line) else _kept(line, _straight(line)) for line in text.split("\n"))
    return text


def _straight(line: str) -> str:
    """The line without what stands between straight marks: from one after a blank to one before a blank or stop.

    Where data is quoted, marks within it are passed over.
    """
    marks = [k for k, c in enumerate(line) if c == '"']
    closing = [k for k in marks if k + 1 == len(line) or line[k + 1].isspace() or line[k + 1] in ".,;:!?)"]
    out, at = [], 0
    for k in marks:
        if k < at or (k and not line[k - 1].isspace() and line[k - 1] != "("):
            continue
        after = closing if line[k + 1 : k + 2] in ("{", "[") else marks
        n = bisect_left(after, k + 1)
        if n < len(after) and (after is closing or closing[bisect_left(closing, after[n]) :][:1] == [after[n]]):
            out.append(line[at:k] + " " * (after[n] + 1 - k))
            at = after[n] + 1
    return "".join(out) + line[at:]


def _kept(line: str, blanked: str) -> str:
    """blanked, unless hardly a word is left: then the line is no prose about a quotation."""
    return blanked if blanked == line or len(_WORD.findall(blanked)) >= 3 else line


def _automaton(entries):
    import ahocorasick

    automaton, by = ahocorasick.Automaton(), {}
    for phrase, what in entries:
        by.setdefault(phrase, []).append(what)
    for phrase, all_ in by.items():
        automaton.add_word(phrase, (all_, len(phrase)))
    automaton.make_automaton()
    return automaton


class Detector:
    def __init__(self):
        messages = {"error": (STATES, THINGS, BESIDES), "filler": (FILLER_STATES, FILLER_THINGS, FILLER_BESIDES), "script": (SCRIPT_STATES, SCRIPTS, SCRIPT_BESIDES)}
        self.small = _small()
        # the words of segments, by kind of message: 0 a state, 1 a thing, 2 what is beside; 3 a state that is enough
        self.words = {
            kind: _automaton((w.rstrip("!"), 3 if w.endswith("!") else place) for place, text in enumerate(lists) for w in _entries(text))
            for kind, lists in messages.items()
        }
        # the first pass: states of errors and stand-ins, scripts by their name, and the gates of the forms
        gates = [(w.rstrip("!"), kind) for kind, text in (("error", STATES), ("filler", FILLER_STATES), ("script", SCRIPTS)) for w in _entries(text)]
        gates += [(p, "certain") for p in _entries(CERTAIN)] + [(p, "stock") for p in _entries(STOCK)]
        for kind, phrases in {
            "slot": OPENINGS + SIGNED + ODD,
            "trace": TRACES + ODD,
            "code": CODED.split("|") + REASONS.split("|") + ODD,
            "run": STARTS + ODD,
            "about": PAIRS + ODD,
            "keys": KEYS + ODD,
            "latin": sorted(LATIN_RARE),
        }.items():
            gates += [(p, kind) for p in phrases]
        # whatever a form accepts holds at least so many hits of its kind
        self.least = {"slot": 1, "trace": 1, "code": 1, "run": 2, "about": 1, "keys": 1, "latin": RARE}
        self.automaton = _automaton(gates)

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) of the residue in a text; places are those of `cleaned` text.

        A text with characters beyond ASCII is looked at a second time without them, for what is
        spelt with stray ones; that counts only if the first look finds nothing.
        """
        if not text:
            return []
        text = cleaned(text)
        found = self._look(text)
        if not found and (not text.isascii() or _SPLIT.search(text)):
            plain = _SPLIT.sub("", _FOREIGN.sub("", text.replace("“", '"').replace("”", '"').replace("„", '"').replace("«", '"').replace("»", '"')))
            found = self._look(plain) if plain != text else []
        return found

    def _look(self, text: str) -> list[tuple[str, int, int]]:
        low = _lower(text)
        hits = list(self.automaton.iter(low))
        if not hits:
            return []
        if "“" in text or '"' in text or "„" in text or "«" in text:
            text = _unquoted(text)
            low = _lower(text)
            hits = list(self.automaton.iter(low))
        counts = Counter(kind for _, (of, _) in hits for kind in of)
        out = [(as_, end + 1 - n, end + 1) for end, (of, n) in hits for kind, as_ in (("certain", "error"), ("stock", "filler")) if kind in of]
        for kind, pattern in PATTERNS.items():
            if counts[kind] >= self.least[kind]:
                for start, stop in _near([end + 1 - n for end, (of, n) in hits if kind in of], text):
                    out += [(kind, *m.span()) for m in pattern.finditer(text, start, stop)]
        if counts["latin"] >= self.least["latin"]:
            out += _latin_runs(text)
        if counts["error"] or counts["filler"] or counts["script"]:
            ends = [m.span() for m in _ENDS.finditer(text)]
            stops, seen = [s for s, _ in ends], set()
            for end, (of, n) in hits:
                for kind in of:
                    if kind in self.words and _starts_word(low, end + 1 - n):
                        # the hit may hold a full stop; its segment is the one that it ends in
                        k = bisect_left(stops, end)
                        start, stop = ends[k - 1][1] if k else 0, stops[k] if k < len(stops) else len(text)
                        if (kind, start) not in seen:
                            seen.add((kind, start))
                            if self._is_message(kind, low[start:stop]):
                                out.append((kind, start, stop))
        return out

    def _is_message(self, kind: str, segment: str) -> bool:
        """Whether a segment, in lower case, is a message of this kind and little else."""
        places, told, covered = [], set(), bytearray(len(segment))
        for end, (of, n) in self.words[kind].iter(segment):
            start = end + 1 - n
            if _starts_word(segment, start):
                places.append((start, end + 1, of))
                covered[start : end + 1] = b"\1" * n
        # a word counts as a whole if an entry begins it; small words don't count
        total = met = 0
        for m in _TERM.finditer(segment):
            if _WIDE.match(m[0]):
                total += len(m[0])
                met += sum(covered[m.start() : m.end()])
            else:
                hit = any(covered[m.start() : m.end()])
                if hit or m[0].split("'")[0] not in self.small:
                    total += len(m[0])
                    met += len(m[0]) * hit
        share = COVERED_SCRIPT if kind == "script" else COVERED
        if not total or met < share * total:
            return False
        states = {(s, e) for s, e, of in places if 0 in of or 3 in of}
        things = {(s, e) for s, e, of in places if 1 in of}
        if any(3 in of for _, _, of in places):
            return True
        # a state and a thing that are different words, or two states apart
        return any(e <= s2 or e2 <= s for s, e in states for s2, e2 in things | states)


def cleaned(text: str) -> str:
    """Composed text with straight apostrophes and blanks, without what can't be seen and pictures."""
    if text.isascii():
        return text
    text = _HIDDEN.sub("", unicodedata.normalize("NFC", text))
    return _PICTURE.sub("", text).replace("’", "'").replace("\xa0", " ")


def _near(places: list[int], text: str) -> Iterator[tuple[int, int]]:
    """Parts of the text that hold these places, in order: with the line before and two lines after each."""
    start = stop = 0
    for at in sorted(places):
        if at < stop:
            continue
        before = text.rfind("\n", 0, max(0, text.rfind("\n", 0, at)))
        after = at
        for _ in range(3):
            after = text.find("\n", after + 1)
            if after < 0:
                after = len(text)
                break
        if stop and before < stop:
            stop = after
            continue
        if stop:
            yield start, stop
        start, stop = before + 1, after
    if stop:
        yield start, stop


def _starts_word(text: str, at: int) -> bool:
    return at == 0 or not text[at - 1].isalpha() or bool(_WIDE.match(text[at]) or _WIDE.match(text[at - 1]))


def _lower(text: str) -> str:
    """Lower case, character for character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def _latin_runs(text: str) -> Iterator[tuple[str, int, int]]:
    words, run = set(LATIN), []
    for m in [*_WORD.finditer(text), None]:
        if m and m[0].lower() in words:
            run.append(m)
            continue
        if len(run) >= RUN and sum(x[0].lower() in LATIN_RARE for x in run) >= RARE:
            yield "filler", run[0].start(), run[-1].end()
        run = []


_detector: list[Detector] = []


def _ready() -> Detector:
    if not _detector:
        _detector.append(Detector())
    return _detector[0]


def _found(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = _ready()
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for id_, text in zip(ids, batch.column(1).to_pylist()):
                spans = detector.spans(text)
                if spans:
                    upto = covered = 0
                    for _, start, end in sorted(spans, key=lambda x: x[1:]):
                        covered += max(0, end - max(start, upto))
                        upto = max(upto, end)
                    share = min(1.0, covered / max(1, len(cleaned(text))))
                    if share >= least:
                        out.append((id_, sorted({KINDS.get(k, k) for k, *_ in spans}), len(spans), share))
            columns = zip(*out) if out else [[]] * 4
            kinds = (pa.int64(), pa.list_(pa.string()), pa.int32(), pa.float64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "kinds", "hits", "coverage"])

    return run


#: Forms by the kind of residue that they are.
KINDS = {"run": "filler", "about": "filler", "keys": "filler", "trace": "error", "code": "error"}


def residue(documents: DataFrame, coverage: float = 0.0) -> DataFrame:
    """(doc_id, kinds, hits, coverage) of the documents (doc_id, text) whose text holds residue.

    kinds are among error, filler, script and slot; coverage is the share of the cleaned text's
    characters that hits cover, and documents with less than the parameter don't come out: at 0 a
    single hit anywhere is enough. Null and empty texts hold none. Rows are looked at one by one, in
    whole, where they lie: there is no shuffle. doc_id may be null or repeated.
    """
    return documents.select("doc_id", "text").where("text is not null").mapInArrow(
        _found(coverage), "doc_id bigint, kinds array<string>, hits int, coverage double"
    )


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(read(spark, sf_dir, "documents")).select("doc_id")


def p9_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of residue that each document holds, and how much of it they cover."""
    return residue(read(spark, sf_dir, "documents")).withColumn("coverage", F.round("coverage", 6))
