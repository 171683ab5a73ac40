"""Labelled exemplars of residue: passages that stand where an article should be.

error: what servers and programs say instead of a page. script: notices that scripts or
cookies are needed. filler: text that only fills space. chrome: what pages of any kind
carry beside their content; it is covered, but no sign of residue by itself.
"""

#: Numbers and names of the responses that error pages are headed by.
STATUSES = """400 Bad Request
401 Unauthorized
403 Forbidden
404 Not Found
405 Method Not Allowed
408 Request Timeout
410 Gone
429 Too Many Requests
451 Unavailable For Legal Reasons
500 Internal Server Error
502 Bad Gateway
503 Service Temporarily Unavailable
503 Service Unavailable
504 Gateway Time-out"""

ERROR = """Error 404
Page not found
File not found
Oops! Something went wrong
An error has occurred
An unexpected error occurred while processing your request
Application error: a client-side exception has occurred
Access denied
You don't have permission to access this resource
You do not have permission to view this page
You are not authorized to view this page
The requested URL was not found on this server
The requested address was not found on this server
The page you are looking for does not exist or has been moved
The page you requested could not be found
This page isn't available
This page is no longer available
Sorry, we can't find that page
We can't find that story
This article is no longer available
The link you followed may be broken, or the page may have been removed
The link you followed may be broken, or the article may have been removed
Please try again in a few minutes
Please try again later
Reload the page and sign in again
Please refresh the page or log in again
Return to the home page or use search
Go back to the homepage
The server is temporarily unable to service your request due to maintenance downtime or capacity problems
The server is unable to handle the request because of maintenance
The server encountered an internal error and was unable to complete your request
The upstream server returned an invalid response
The server did not respond in time
This site can't be reached
Service unavailable, we are down for scheduled maintenance and will be back soon
Connection to the database could not be made
Error establishing a database connection
Our team has been told about the problem
Our engineers have been notified and are working on a fix
Unexpected token in response
Unexpected token < in JSON at position 0
Traceback (most recent call last):
KeyError: 'headline'
TypeError: Cannot read properties of undefined
NullPointerException at line
Fatal error: Uncaught exception
Warning: undefined variable on line
Your session has expired
Session expired, please log in again
Too many requests, you have been rate limited
Your request has been blocked for security reasons
Checking your browser before you continue
Verify you are human by completing the action below
Seite nicht gefunden
Die angeforderte Seite existiert nicht oder wurde verschoben
Die Seite konnte nicht gefunden werden
Interner Serverfehler
Es ist ein Fehler aufgetreten, bitte versuchen Sie es später erneut
Zugriff verweigert, Sie haben keine Berechtigung für diese Seite
Der Dienst ist vorübergehend nicht verfügbar
Page introuvable
La page demandée n'existe plus
La page que vous recherchez est introuvable ou a été déplacée
Erreur interne du serveur
Une erreur est survenue, veuillez réessayer plus tard
Accès refusé, vous n'avez pas l'autorisation de consulter cette page
Le service est temporairement indisponible
Página no encontrada
La página solicitada no existe
La página que busca no existe o ha sido movida
Error interno del servidor
Se ha producido un error, inténtelo de nuevo más tarde
Acceso denegado, no tiene permiso para ver esta página
El servicio no está disponible temporalmente
Pagina non trovata, la pagina richiesta non esiste
Si è verificato un errore, riprova più tardi
Página não encontrada, a página solicitada não existe
Ocorreu um erro, tente novamente mais tarde
Pagina niet gevonden, de opgevraagde pagina bestaat niet
Nie znaleziono strony, żądana strona nie istnieje
Страница не найдена, запрошенная страница не существует
ページが見つかりません
页面不存在 找不到页面
페이지를 찾을 수 없습니다"""

SCRIPT = """Please enable JavaScript to view this page
Please enable JavaScript and cookies to continue
You need to enable JavaScript to run this app
JavaScript is disabled in your browser
JavaScript is turned off in your browser
JavaScript is required to use this site
We've detected that JavaScript is disabled in this browser
We've detected that active scripting is disabled in this browser
This site requires JavaScript to work properly
This site requires scripts to work properly
Scripts must be allowed
Switch it on and reload to read the article
To continue, turn on JavaScript and cookies
Turn on JavaScript in your browser settings and reload the page
Here is how to change the setting in your browser
Here are the instructions how to enable JavaScript in your web browser
Your browser does not support JavaScript or scripts are blocked
Your browser does not run scripts, so the content cannot be shown
Your browser does not run scripts, so the quotes cannot be shown
Loading… If nothing appears, allow scripts for this site
Content is loading, please wait or enable scripts
noscript: content unavailable
Please turn off your ad blocker and reload the page
Cookies are disabled, please accept cookies to read this page
Bitte aktivieren Sie JavaScript, um den Artikel zu lesen
Bitte aktivieren Sie JavaScript in Ihrem Browser, um diese Seite anzuzeigen
JavaScript ist deaktiviert, diese Seite benötigt JavaScript
Veuillez activer JavaScript pour afficher cette page
JavaScript est désactivé dans votre navigateur, activez-le pour continuer
Ce site nécessite JavaScript pour fonctionner correctement
Active JavaScript en su navegador para continuar
Por favor, habilite JavaScript para ver esta página
Este sitio requiere JavaScript para funcionar correctamente
Abilita JavaScript per visualizzare questa pagina, JavaScript è disattivato
Ative o JavaScript no seu navegador para ver esta página, habilite o JavaScript
Schakel JavaScript in om deze pagina te bekijken
Włącz JavaScript w przeglądarce, aby wyświetlić stronę
Включите JavaScript в браузере, чтобы просмотреть эту страницу
JavaScriptを有効にしてください このページを表示するには
请启用 JavaScript 以继续
자바스크립트를 활성화해 주세요"""

#: The words of the usual Latin dummy text; a passage made of these is filler.
LATIN = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat
duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur
excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum"""

FILLER = """Lorem ipsum dolor sit amet
This is sample text. Replace it with the real story
This is placeholder text
This is a dummy text for layout purposes
Sample article for testing only
Example article
Text goes here
Insert text here
Your content here
Your content will appear in this space
Article text
Insert summary
Insert quote
Insert closing line
First paragraph
Second paragraph
Third paragraph
Dummy article used to test the feed
Placeholder paragraph for layout only, do not publish
Blah blah blah, more words here later
Headline goes here
Standfirst goes here
Body copy goes here
Body text to come
Caption to come
Byline to come
Story to come
Content coming soon
To be written
To be announced
TBD TBD TBD
TK TK TK
Text text text
Test test test
Test one two three
Hello world
This is a test, please ignore
This story is a stub made by the import job
This article is a stub
Foo bar baz
asdf asdf qwer asdf zxcv asdf qwerty
Texte provisoire à remplacer par l'article
Texte de remplissage, faux texte
Platzhaltertext, hier steht später der Artikel
Blindtext, hier steht später der Artikel
Dies ist ein Blindtext, Beispieltext
Texto de relleno, sustituir antes de publicar
Texto provisional que se sustituirá por el artículo
Este es un texto de prueba de ejemplo
Testo segnaposto, testo di prova
Texto de exemplo, texto provisório
Voorbeeldtekst, tijdelijke tekst
Текст-заполнитель, пример текста
サンプルテキスト ダミーテキスト
这是示例文本 占位文本"""

CHROME = """Loading
Please wait
Then refresh
Thank you
nginx
Apache Server at Port
Cloudflare Ray ID
Error code
Reference
Request ID
Incident was logged
Home | Contact | Terms
Help Center - Terms - Privacy
Sign in
Log in or register
Contact us
Copyright All rights reserved
Accueil Contact Mentions légales
Startseite Kontakt Impressum
Inicio Contacto Aviso legal"""

#: Values that were never filled in, as templates of many kinds write them. FIELD is a name (a word, or several joined by one
#: sign), TEXT anything up to the closing signs, NAME one or more words that must pass for the name of a field by their form.
PLACEHOLDER = """{{TEXT}}
{% FIELD TEXT? %}
<% TEXT %>
<%= TEXT %>
${FIELD}
#{FIELD}
{FIELD}
%(FIELD)s
%(FIELD)d
%(FIELD)f
@@FIELD@@
*| LINE |*
$$FIELD$$
<< FIELD >>
[[ FIELD ]]
__FIELD__
%FIELD%
<NAME>
[NAME]
[insert LINE]
[enter LINE]
[add LINE]
(insert LINE)
(enter LINE)
(add LINE)
<insert LINE>
<enter LINE>
<add LINE>
[LINE here]
[your LINE]"""

#: Words of which the names of fields are made; a name in single brackets that has others is judged by what stands around it.
FIELDS = """first last full user company client customer analyst speaker author city place region country date month quarter session
ticker symbol issuer amount value volume revenue price margin total count num number eps target reason percent pct title headline
source link url name report close prior as of change"""

#: Each word is an exemplar of how a passage shows that it speaks of a template instead of having been left as one.
MENTION = """template templates templated placeholder placeholders variable variables syntax draft drafts mock mockup mockups
tutorial documentation developer developers markup snippet merge mailmerge tag tags literal literally braces brackets curly backticks
example examples sample samples quoted quotes quoting slip typo lorem parser compiler programmers coders
vorlage vorlagen platzhalter variablen beispiel entwürfe syntaxe modèle gabarit variable exemple brouillons
plantilla plantillas marcador variable ejemplo borradores"""

#: Words that stand in brackets as remarks or insertions of an editor, not as names of fields.
EDITORIAL = """
sic recte emphasis added original translated translation edit edited editor editors ed redacted deleted removed omitted corrected correction update updated continued
applause laughter laughs laughing inaudible unintelligible indiscernible unclear crosstalk pause music sighs citation needed note
video photo image audio graphic chart table advertisement ad sponsored opinion exclusive breaking live more see
reuters ap afp bloomberg dpa usd eur gbp jpy chf million billion trillion thousand percent
i you he she it we they me him her us them my your his its our their who which the a an this that these those and or but nor not no yes
is are was were be been being am has have had do does did will would can could may might should must than so such if when while because
er sie es wir ich der die das den dem und oder il elle le la les un une et ou el los las una y
"""
#: Prepositions, which may stand within the name of a field but don't begin one.
PREPOSITIONS = "of as for to by in on at from with per about under over into"
