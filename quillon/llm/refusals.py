"""Answers that decline: an automaton over the words by which a speaker declines, in eleven languages.

One Aho-Corasick pass over a sentence gives the classes of its words: the speaker, negation, ability, what is to be done
(answering, helping), knowledge, declining, want, information, what was given, the speaker's role. A sentence declines
if the classes of one of the RECIPES stand close together, whatever the words between them. No whole phrase is listed.
"""

from __future__ import annotations

import functools

import ahocorasick
import regex

#: Characters within which the words of a recipe stand: spaced scripts, others.
NEAR, NEAR_DENSE = 100, 40
# The classes that decline when they stand together. `me` is the speaker, `mayme` a verb that may be
# the speaker's, `mine` a verb of ability in the
# first person, `plain` one of any person, `do` what is asked of the speaker, `ans` answering alone, `lead` a verb or
# negation with which the sentence begins, `go` what goes with a refusal.
PERSONAL = ("lead", "me", "this", "given", "go")
RECIPES = tuple(map(frozenset, (
    {"me", "not", "do"}, {"mayme", "not", "able", "do"}, {"mine", "not", "do"}, *({"plain", "not", "do", p} for p in PERSONAL), {"go", "not", "able", "ans"},
    {"me", "decline"}, {"declined"}, {"me", "not", "know"}, {"mine", "not", "know"}, {"notknow"}, *({"unknown", p} for p in PERSONAL),
    {"me", "not", "info"}, {"me", "lack", "info"}, {"mayme", "not", "info"}, {"mayme", "lack", "info"}, {"lack", "info", "ans"}, {"not", "info", "ans", "given"}, {"not", "able", "ans", "given"}, {"not", "able", "ans", "this"}, {"not", "bare"},
    {"role", "not", "me"}, {"role", "not", "mine"}, {"role", "not", "plain"}, {"role", "decline", "me"},
    {"me", "not", "scope"}, {"me", "beyond", "scope"}, {"me", "not", "rules"}, {"me", "forbid", "rules"}, {"me", "not", "right"}, {"notme", "other"},
)))
# Words of each class; * stands for any further letters. `mine` is a verb of ability in the first person, `do` what is asked of the speaker.
WORDS = {
    "eng": {
        "ans": "answer*|respond*|reply*|response", "me": "i|i'm|i've|i'd|i'll|me|my|we|we're|myself", "not": "not|cannot|can't|couldn't|won't|wouldn't|don't|doesn't|isn't|aren't|didn't|unable|never|no|nothing|none|neither|impossible|incapable|hardly|nowhere",
        "able": "can|cannot|can't|could|couldn't|able|unable|position|permitted|allowed|will|won't|would|wouldn't|shall|equipped|qualified|authori*|comfortable|willing|prepared|going|possible|impossible|capable|incapable|lets|let|allow*|permit*|enabl*|be",
        "do": "answer*|respon*|reply*|help*|assist*|provid*|give|offer*|say*|tell*|advis*|advice|comment*|determin*|address*|discuss*|suppl*|share*|opinion*|settle*|confirm*|comply|fulfil*|engage*|conclu*|assess*|resolv*|establish*|recommend*|contain*|mention*|cover*|speak*|deduc*|infer*",
        "know": "know|sure|certain|aware|idea|clue", "decline": "declin*|refus*|abstain*|refrain*|rather not|prefer not|withhold*|must pass|have to pass|choose not", "lack": "lack*|insufficient*|missing|too little|not enough|no sufficient|not sufficient",
        "info": "information|context|data|material*|passages|documents|sources|excerpt*|extract*|details|evidence|text|texts|basis|knowledge|paragraphs|facts", "given": "provided|given|supplied|available|at hand|above|shown|before me|in front of me|i have|i was|i received|here", "this": "this question|your question|this request|your request|that question|this query|your query",
        "bare": "answer can be given|answer is possible|answer is available|answer available", "role": "as an ai|as a language model|as an assistant|as an automated|as a virtual|as an artificial|as a chatbot|i am an ai|i'm an ai|i am only an|language model|ai assistant|automated assistant",
        "scope": "my remit|my scope|my competence|my abilities|my capabilities|what i can|what i am able|my expertise|my knowledge", "beyond": "beyond|outside|exceed*|surpass*", "rules": "my instructions|my guidelines|my rules|my policy|my programming|my settings", "forbid": "forbid*|prohibit*|prevent*|bar me|keep me from|stop me", "right": "appropriate|right for me|proper for me|suitable|my place|advisable|responsible",
        "notme": "not to me|not for me|not from me|not me", "other": "lawyer|counsel|solicitor|professional|expert|attorney|advocate", "go": "please|consult*|unfortunately|regrettably|sorry|apolog*|try asking|rephras*|contact|seek|ask a|ask another|afraid|with regret",
    },
    "fre": {
        "ans": "répon*", "me": "je|j'*|m'*|me|moi|mon|ma|mes|nous", "mine": "peux|saurais|pourrai|pourrais", "not": "ne|n'*|pas|aucun|aucune|rien|impossible|incapable|ni|non|jamais",
        "able": "peux|peut|puis|pouvoir|saurais|pourrai*|mesure|possible|impossible|capable|incapable|autoris*|permet*|permis|habilit*|souhait*|veux|voudrais|vais|état|suis|donn*|être",
        "do": "répon*|aid*|assist*|fourni*|donner|dire|apport*|conseil*|comment*|détermin*|tranch*|trait*|prononc*|formul*|avis|exprim*|discut*|renseign*|préciser|confirm*|satisf*|suite|conclu*|établi*|éclair*|indiqu*|contien*|mentionn*|disent|dit",
        "know": "sais|ignore|connais|certain|sûr|idée", "decline": "refuse*|refuser|décline*|décliner|m'abst*|abstenir|préfère ne|préfèrerais ne|préférerais ne|dispense*|renonce*|m'excuse de ne|passer mon tour", "lack": "manque*|insuffisan*|fait défaut|font défaut|pas assez|pas suffisamment|trop peu",
        "info": "information*|contexte|éléments|donnée*|document*|passage*|extrait*|source*|matière|connaissance*|précisions|paragraphes|texte*|renseignements", "given": "fourni*|donné*|transmis*|disponible*|à ma disposition|soumis*|reçu*|ci-dessus|remis*|dont je dispose|disposition", "this": "cette question|votre question|cette demande|votre demande|ladite question",
        "bare": "réponse possible|réponse ne peut|réponse n'est", "role": "en tant qu'*|en ma qualité|modèle de langage|assistant virtuel|assistant automatique|intelligence artificielle|simple assistant", "scope": "ce que je peux|mes compétences|ma compétence|mes capacités|mon ressort|mes attributions|mon domaine", "beyond": "dépass*|au-delà|hors|excèd*|relève*|sort",
        "rules": "mes instructions|mes consignes|mes règles|mes directives|ma programmation", "forbid": "interdi*|défend*|empêch*|proscri*", "right": "approprié|opportun|convenable|à ma place|indiqué", "notme": "et non de moi|et non à moi|pas à moi|pas de moi", "other": "avocat*|juriste*|conseil|professionnel*|expert*",
        "go": "veuillez|merci de|malheureusement|à regret|désolé*|excus*|consult*|adress*|reformul*|prière|pardon|regret*|s'il vous plaît",
    },
    "ron": {
        "ans": "răspun*", "me": "eu|îmi|mi|mă|m-*|mie|mea|meu|mele|ceea ce pot|ce pot face", "mayme": "noi|sunt|am", "declined": "să refuz|refuz să|vă refuz|prefer să nu|aș prefera să nu|mă abțin|declin orice", "mine": "știu|vreau|doresc", "plain": "pot|putea|voi|aș", "not": "nu|n-*|niciun|nicio|nimic|imposibil|incapabil|nici|niciodată",
        "able": "pot|poate|putea|voi|aș|măsură|posibil|imposibil|capabil|incapabil|stare|autoriz*|permit*|permis|vreau|doresc|abilit*",
        "do": "răspun*|ajut*|asist*|oferi*|ofer|da|dau|spun*|spune|furniza*|comenta*|stabili*|determina*|pronunț*|exprim*|opini*|sfat*|sfătui*|discut*|trata*|preciz*|confirma*|formula*|conclu*|lămuri*|soluțion*|conțin*|menționeaz*|deduce*",
        "know": "știu|cunosc|sigur|idee|habar", "decline": "refuz|refuza|declin|declina|abțin|abține|prefer să nu|aș prefera să nu|renunț|mă feresc", "lack": "lips*|insuficient*|nu sunt suficiente|nu am suficiente|destule|prea puțin*|suficiente",
        "info": "informați*|context*|date|datele|document*|pasaj*|fragment*|surs*|elemente*|material*|cunoștinț*|detalii|text*|paragraf*", "given": "furnizat*|oferit*|primit*|disponibil*|puse la dispoziție|avut*|de mai sus|prezentat*|date", "this": "această întrebare|întrebarea dumneavoastră|întrebarea dvs|această cerere|această solicitare|la aceasta",
        "bare": "răspuns posibil|da niciun răspuns|răspuns nu se poate", "role": "ca asistent|ca model|în calitate de asistent|model de limbaj|model lingvistic|inteligență artificială|asistent virtual|asistent automat", "scope": "ceea ce pot|competența mea|competențele mele|capacitatea mea|capacitățile mele|ce pot face", "beyond": "depăș*|în afara|excede*|peste|dincolo",
        "rules": "instrucțiunile mele|regulile mele|programarea mea|indicațiile mele|politica mea", "forbid": "interzic*|împiedic*|opresc", "right": "potrivit|cuvenit|adecvat|indicat", "notme": "nu mie|nu de la mine|nu pe mine", "other": "avocat*|jurist*|specialist*|expert*|consilier*",
        "go": "vă rog|vă rugăm|din păcate|cu regret|îmi pare rău|ne pare rău|scuz*|consultați|adresați|reformulați|încercați|trimiteți|regret*",
    },
    "deu": {
        "ans": "antwort*|beantwort*", "me": "ich|mir|mich|meine*|wir|uns", "not": "nicht|kein*|nichts|unmöglich|außerstande|nie|weder|leider nicht|unfähig|nein", "able": "kann|könnte|können|lage|imstande|außerstande|möglich|unmöglich|darf|dürfen|werde|will|möchte|befugt|berechtigt|vermag|fähig|unfähig|erlaub*|gestatte*|wage|ist|lässt",
        "do": "antwort*|beantwort*|helfen|weiterhelfen|behilflich|hilfe|unterstütz*|geben|angeben|sagen|auskunft|mitteilen|stellung|äußern|beurteil*|bestimm*|entscheid*|kommentier*|beraten|rat|festst*|einschätz*|bestätig*|liefern|bereitst*|besprechen|eingehen|erteil*|enthalt*|entnehm*",
        "know": "weiß|wissen|bekannt|sicher|ahnung", "decline": "lehne|ablehnen|abzulehnen|verweiger*|weigere|verzicht*|absehen|sehe davon ab|enthalte|enthalten|lieber nicht", "lack": "fehl*|mangel*|unzureichend*|nicht genug|nicht genügend|nicht ausreichend|keine ausreichenden|zu wenig",
        "info": "information*|kontext|angaben|daten|unterlagen|dokument*|auszüge*|passage*|quelle*|material|kenntniss*|hinweise|text*|absätze*", "given": "vorliegend*|gegeben*|vorhanden*|bereitgestellt*|verfügung|verfügbar*|erhalten*|obigen|vorgelegt*|mir vor", "this": "diese frage|ihre frage|dieser frage|ihrer frage|diese anfrage|dieser anfrage|das",
        "bare": "antwort möglich|antwort gegeben|antwort vorhanden", "role": "als ki|als sprachmodell|als assistent*|als automatisch*|künstliche intelligenz|sprachmodell|als virtuell*", "scope": "meine möglichkeiten|meinen möglichkeiten|meine kompetenz*|meiner kompetenz*|meine fähigkeiten|meiner zuständigkeit|was ich kann", "beyond": "übersteig*|außerhalb|jenseits|überschreit*|hinaus",
        "rules": "meine anweisungen|meine vorgaben|meine regeln|meine richtlinien", "forbid": "verbiet*|untersag*|hindern", "right": "angemessen|angebracht|passend|ratsam", "notme": "nicht an mich|nicht von mir", "other": "anwalt|anwältin|rechtsanwalt|fachmann|experte*|juristen",
        "go": "bitte|leider|bedau*|entschuldig*|tut mir leid|wenden sie|konsultier*|verzeih*|formulier*|fragen sie",
    },
    "spa": {
        "ans": "respon*|contest*", "me": "yo|me|mi|mis|estoy|tengo|soy|lo que puedo", "declined": "me niego|me abstengo|rehúso|prefiero no|preferiría no|debo declinar|debo rehusar", "mine": "puedo|podré|podría|quiero|deseo|voy|sé", "not": "no|ningun*|ningún|nada|imposible|incapaz|nunca|tampoco", "able": "puedo|puede|podré|podría|posible|imposible|capaz|incapaz|condiciones|autorizado|permit*|voy|quiero|deseo|capacitado|facultado|es",
        "do": "respon*|contest*|ayud*|asist*|ofrec*|dar|daré|decir*|decirle|proporcion*|coment*|determin*|pronunci*|opin*|aconsej*|tratar|aclar*|confirm*|facilitar|resolver|atender|indicar|contien*|mencion*|deduc*", "know": "sé|conozco|seguro|idea|consta", "notknow": "desconozco|ignoro|lo ignoro",
        "decline": "rehúso|declino|declinar|rechaz*|me niego|abstengo|abstenerme|prefiero no|preferiría no|renuncio|excusarme", "lack": "falta*|insuficient*|carezco|carece*|no dispongo|no tengo|suficient*", "info": "información|contexto|datos|documento*|pasaje*|fragmento*|fuente*|elementos|material*|conocimiento*|texto*|párrafos|detalles",
        "given": "proporcionad*|facilitad*|dad*|disponible*|recibid*|entregad*|anterior*|aportad*", "this": "esta pregunta|su pregunta|tu pregunta|esa pregunta|esta solicitud|su solicitud|esta consulta|su consulta|ello|eso", "bare": "respuesta posible|dar respuesta|dar ninguna respuesta", "role": "como ia|como modelo|como asistente|como inteligencia|modelo de lenguaje|asistente virtual|inteligencia artificial",
        "scope": "lo que puedo|mi competencia|mis competencias|mis capacidades|mi alcance|mi ámbito", "beyond": "supera*|fuera|excede*|más allá|sobrepasa*", "rules": "mis instrucciones|mis normas|mis reglas|mis directrices", "forbid": "prohíb*|impid*|vedan", "right": "apropiado|adecuado|oportuno|correcto", "notme": "no a mí|no de mí", "other": "abogad*|jurista*|profesional*|expert*",
        "go": "por favor|lamentablemente|desgraciadamente|lo siento|disculp*|perdón|consulte*|diríjase|reformule*|lamento",
    },
    "ita": {
        "ans": "rispo*|rispond*", "me": "io|mi|mio|mia|miei|mie|ho|dispongo|ciò che posso|quello che posso", "mayme": "sono", "declined": "mi astengo|preferisco non|preferirei non|mi rifiuto|devo rifiutare|devo declinare", "mine": "posso|potrei|potrò|voglio|intendo|so|saprei", "not": "non|nessun*|nulla|niente|impossibile|incapace|mai|né", "able": "posso|può|potrei|potrò|possibile|impossibile|capace|incapace|grado|autorizzat*|permess*|permett*|condizione|voglio|intendo|saprei|è|abilitat*",
        "do": "rispo*|rispond*|aiut*|assist*|fornir*|dare|dire|dir*|offr*|comment*|determin*|pronunci*|esprim*|parere|consigli*|chiar*|conferm*|trattare|stabil*|indicar*|contengono|contiene|menzion*|dedurre", "know": "so|conosco|sicur*|idea|certo", "notknow": "ignoro|lo ignoro", "decline": "rifiuto|rifiutare|declino|declinare|astengo|astenermi|preferisco non|preferirei non|rinuncio|esimo",
        "lack": "manc*|insufficient*|carent*|abbastanza|sufficient*|privo", "info": "informazion*|contesto|dati|document*|passagg*|estratt*|font*|element*|material*|conoscenz*|test*|dettagli", "given": "fornit*|dat*|disponibil*|ricevut*|a disposizione|precedent*|trasmess*|sottopost*", "this": "questa domanda|sua domanda|tua domanda|questa richiesta|sua richiesta|tale domanda|questo quesito",
        "bare": "risposta possibile|dare alcuna risposta|risposta non", "role": "come ia|come modello|come assistente|in quanto ia|in quanto assistente|modello linguistico|intelligenza artificiale|assistente virtuale|in quanto modello", "scope": "ciò che posso|quello che posso|mie competenze|mia competenza|mie capacità|mie possibilità", "beyond": "super*|fuori|oltre|esula*|al di là|eccede",
        "rules": "mie istruzioni|mie regole|mie linee guida", "forbid": "vietano|proib*|impedi*", "right": "opportuno|appropriato|corretto", "notme": "non a me|non da me", "other": "avvocat*|legale|professionist*|espert*", "go": "per favore|purtroppo|mi dispiace|spiacent*|scus*|consult*|rivolg*|riformul*|la prego|mi rincresce",
    },
    "rus": {
        "ans": "отве*", "me": "я|мне|меня|мной|мы|нам|моя|мои|моей|моих", "mine": "могу|смогу|буду|вправе|готов|готова|знаю|берусь|хочу|решусь", "not": "не|нет|ни|невозможно|никак*|нельзя|ничего", "able": "могу|смогу|может|можно|состоянии|вправе|возможност*|возможно|невозможно|способ*|буду|готов*|имею|удастся|уполномоч*|позвол*|хочу|берусь",
        "do": "отве*|помо*|сказать|дать|дам|предостав*|сообщ*|комментир*|прокомментир*|определ*|установ*|выска*|мнени*|совет*|консульт*|обсужд*|подтверд*|разъясн*|судить|оцен*|решить|рассмотр*|содерж*|упомина*", "know": "знаю|уверен*|известно|понимаю|представляю", "notknow": "затрудняюсь|неизвестно мне|мне неизвестно|не располагаю|не владею",
        "declined": "отказываюсь|воздержусь|воздерживаюсь|предпочту не|предпочитаю не|предпочёл бы не|вынужден отказать|вынуждена отказать|вынужден отклонить", "decline": "отказ*|воздерж*|отклон*|уклон*|предпочту не|предпочитаю не|предпочёл бы не|вынужден*", "lack": "недостат*|не хвата*|мало|отсутств*|недостаточ*", "info": "информаци*|контекст*|данны*|сведени*|документ*|отрывк*|фрагмент*|источник*|материал*|знани*|текст*|пункт*", "given": "предоставлен*|данных|имеющ*|получен*|приведён*|приведен*|доступн*|переданн*|представлен*|выше", "this": "этот вопрос|ваш вопрос|данный вопрос|этому вопросу|вашему вопросу|такой вопрос",
        "bare": "ответ невозможен|ответа нет|дать ответ", "role": "как ии|как модель|как языковая|как ассистент|как помощник|языковая модель|искусственный интеллект|виртуальный", "scope": "моих возможностей|мои возможности|моей компетенции|мою компетенцию|мои полномочия|моих полномочий", "beyond": "выход*|за пределами|за рамк*|превыша*|вне", "rules": "мои инструкции|мои правила|моими инструкциями|моим инструкциям", "forbid": "запрещ*|не позволя*|мешают", "right": "уместно|корректно|правильно|надлежаще",
        "notme": "не ко мне|не мне", "other": "юрист*|адвокат*|специалист*|эксперт*", "go": "пожалуйста|к сожалению|извин*|прост*|обратитесь|сожале*|переформулир*|проконсульт*|увы",
    },
    "ara": {
        "ans": "الإجابة|إجابة|أجيب|الرد|للإجابة|الجواب|جواب|للرد", "me": "أنا|لست|تعليماتي|قواعدي|إرشاداتي|سياستي|اختصاصي|قدراتي|صلاحياتي|إمكانياتي|قدرتي|أعتذر|لي|لدي|لدى|عندي|إنني|إني|مني|علي|أرى", "mine": "أستطيع|يمكنني|أقدر|بإمكاني|بوسعي|يسعني|أتمكن|أملك|أريد|أود|أعرف|أعلم|باستطاعتي|بمقدوري", "not": "لا|لم|لن|ليس|ليست|لست|غير|تعذر|يتعذر|عاجز|عاجزة|دون|ما", "able": "أستطيع|يمكن|يمكنني|قادر|قادرا|قادراً|مخول|مخولا|مؤهل|مؤهلا|بإمكاني|وسعي|إمكان*|يسمح|تسمح|يتعذر|متاح|مسموح",
        "do": "الإجابة|للإجابة|بالإجابة|الجواب|جواب|إجابة|أجيب|الرد|رد|المساعدة|مساعدت*|أساعد*|تقديم|أقدم|إعطاء|أعطي|أقول|التعليق|تحديد|أحدد|الجزم|إبداء|رأي|رأيا|نصيحة|مشورة|توضيح|تأكيد|البت|أفيد*|إفاد*|الحكم|تتضمن|تذكر|تقول", "know": "أعرف|أعلم|أدري|متأكد*|معرفة|علم", "notknow": "أجهل",
        "declined": "أعتذر عن|أرفض|أمتنع|أفضل عدم|أفضل ألا", "decline": "أعتذر|أرفض|أمتنع|الامتناع|الاعتذار|أتحفظ|أفضل عدم|أفضل ألا", "lack": "تنقصني|ينقصني|تفتقر|أفتقر|غير كاف*|لا تكفي|لا يكفي|كافية|كاف|تنقص|بدون", "info": "معلومات|المعلومات|السياق|سياق|بيانات|البيانات|مستندات|المستندات|مقاطع|المقاطع|النصوص|نصوص|مصادر|المصادر|وثائق|الوثائق|معطيات|المعطيات|النص|الفقرات",
        "given": "المقدمة|المقدم|المتاحة|المتاح|المتوفرة|المعطاة|الواردة|المرفقة|أعلاه|بين يدي|لدي|المذكورة", "this": "هذا السؤال|سؤالك|سؤالكم|هذا الطلب|طلبك|طلبكم|هذه المسألة", "bare": "إعطاء إجابة|تقديم إجابة|إجابة ممكنة|إعطاء جواب", "role": "كنموذج|بصفتي|باعتباري|كمساعد|نموذج لغوي|ذكاء اصطناعي|مساعد آلي", "scope": "اختصاصي|قدراتي|صلاحياتي|إمكانياتي|نطاق عملي|قدرتي", "beyond": "خارج|يتجاوز|تتجاوز|يفوق|يخرج|تخرج", "rules": "تعليماتي|قواعدي|إرشاداتي|سياستي", "forbid": "تمنع*|تحظر|يمنع*", "right": "المناسب|اللائق|الملائم",
        "notme": "وليس إلي|لا إلي", "other": "محام|محاميا|محامي|خبير|مختص", "go": "عذرا|عذراً|للأسف|آسف|أعتذر|يرجى|الرجاء|أرجو|استشر|راجع|من فضلك|مع الأسف|يؤسفني",
    },
    "zho": {
        "ans": "回答|作答|答复|回复|解答|答案", "me": "我|本人|本助手", "plain": "无法|无从|不能|没办法|没法|不便|无力|难以|不会|无权|不可以|不愿|不想|未能|不予|不宜|恕难", "not": "无法|无从|不能|没办法|没法|不便|无力|难以|不会|无权|不可以|不愿|不想|未能|没有|不予|不宜|不足|不|恕难|未", "able": "无法|不能|可以|能够|能",
        "do": "回答|作答|回复|答复|解答|提供|帮助|协助|帮忙|给出|确定|判断|告诉|评论|置评|说明|讨论|表态|发表意见|提出建议|答案|处理|满足|得出|解决|奉告|从命|找到|提及|说", "know": "知道|清楚|确定|了解|肯定", "unknown": "不知道|不清楚|不了解|不得而知|不确定", "decline": "拒绝|谢绝|婉拒|回避|不作回答|不予回答|选择不", "lack": "缺乏|缺少|不足|不够|没有足够|没有", "info": "信息|资料|上下文|材料|依据|内容|文件|段落|数据|背景|证据|文本", "given": "提供的|给定的|现有|所给|上述|已有|手头|目前|收到的|给出的|掌握",
        "this": "这个问题|该问题|此问题|您的问题|你的问题|这一问题|该请求|这个请求|您的请求|本问题", "bare": "无可奉告", "role": "作为ai|作为一个ai|作为人工智能|作为一个人工智能|作为语言模型|作为助手|作为一个语言模型|语言模型|ai助手|作为一名", "scope": "我的能力|我的职责|能力范围|权限|职权", "beyond": "超出|超过|不在|超越", "rules": "我的指令|我的规则|我的准则", "forbid": "禁止|不允许|不准", "right": "合适|适合|适当|妥当", "notme": "而不是我|而非我", "other": "律师|专家|专业人士", "go": "抱歉|对不起|请|遗憾|很遗憾|不好意思|咨询",
    },
    "jpn": {
        "ans": "回答|お答え|答え|返答", "me": "私|当方|わたくし|わたし|弊方", "mine": "できません|出来ません|できかねます|いたしかねます|致しかねます|しかねます|かねます|いたしません", "plain": "できない|出来ない|できかね|しかねる|しません|控え|差し控え|遠慮|見送|不可能|困難|難しい", "not": "できません|できない|できかね|出来ません|出来ない|かねます|かねる|いたしかね|致しかね|なりません|いたしません|しません|控え|遠慮|見送|不可能|困難|難しい|ません|ない|なく|無い", "able": "できません|できない|できかね|出来ません|可能|不可能|立場|能力",
        "do": "回答|お答え|答え|返答|返事|お手伝い|支援|提供|判断|対応|助言|説明|コメント|お伝え|特定|断定|確認|述べ|意見|応じ|お力|申し上げ|言え|記載|触れ", "know": "わかり|分かり|存じ|知り|承知|把握", "notknow": "わかりません|分かりません|存じません|知りません|存じ上げません|わかりかね|分かりかね", "decline": "お断り|拒否|辞退|断ら", "declined": "お断りします|お断りいたします|回答を拒否します|回答を控え|お答えを控え|回答は差し控え|お答えは差し控え|回答を差し控え|お答えを差し控え|回答を辞退|回答を遠慮", "lack": "不足|足り|十分な|十分で|欠け|乏し|ありません",
        "info": "情報|資料|文脈|データ|文書|材料|根拠|段落|記述|内容|手がかり", "given": "提供された|与えられた|いただいた|手元|上記|現在の|ご提示", "this": "この質問|ご質問|その質問|このご質問|本件|この件|ご依頼|このお問い合わせ", "bare": "回答不能", "role": "aiとして|言語モデル|アシスタントとして|人工知能|aiアシスタント", "scope": "私の能力|私の権限|私の範囲|対応範囲", "beyond": "超え|範囲外|越え", "rules": "私の指示|規則|ガイドライン|方針", "forbid": "禁止|許され|認められ", "right": "適切|ふさわし", "notme": "私ではなく", "other": "弁護士|専門家", "go": "申し訳|恐れ入り|すみません|恐縮|残念|ご相談|ください|あいにく",
    },
    "tha": {
        "ans": "ตอบ", "me": "ฉัน|ผม|ดิฉัน|ข้าพเจ้า|เรา", "plain": "ไม่สามารถ|ไม่อาจ|ไม่ขอ|ไม่มีสิทธิ|ไม่ได้รับอนุญาต|ไม่สะดวก|ไม่พร้อม", "not": "ไม่", "able": "สามารถ|อาจ|ได้|อยู่ในฐานะ", "do": "ตอบ|ช่วย|ให้คำ|ให้ข้อมูล|ให้ความเห็น|บอก|ระบุ|แสดงความ|แนะนำ|อธิบาย|วินิจฉัย|สรุป|ยืนยัน|กล่าว|ดำเนินการ", "know": "ทราบ|รู้|แน่ใจ|มั่นใจ", "unknown": "ไม่ทราบ|ไม่รู้|ไม่แน่ใจ", "decline": "ปฏิเสธ|งด|ละเว้น|ขอผ่าน", "declined": "ขอปฏิเสธ|ขอไม่ตอบ|ของดตอบ|ขอสงวน|ขอไม่ให้ความเห็น|ของดให้ความเห็น|ปฏิเสธที่จะตอบ", "lack": "ไม่เพียงพอ|ไม่พอ|ขาด|ไม่มี|เพียงพอ", "info": "ข้อมูล|บริบท|เอกสาร|เนื้อหา|หลักฐาน|ข้อความ|ย่อหน้า",
        "given": "ที่ให้มา|ที่มี|ที่ได้รับ|ข้างต้น|ที่มีอยู่", "this": "คำถามนี้|คำถามของคุณ|คำถามดังกล่าว|คำขอนี้|เรื่องนี้", "role": "ในฐานะ|ปัญญาประดิษฐ์|แบบจำลองภาษา", "scope": "ความสามารถของฉัน|ขอบเขต|อำนาจ", "beyond": "เกิน|นอก", "rules": "คำสั่งของฉัน|กฎของฉัน|นโยบาย", "forbid": "ห้าม|ไม่อนุญาต", "right": "เหมาะสม", "notme": "ไม่ใช่ฉัน", "other": "ทนายความ|ผู้เชี่ยวชาญ", "go": "ขออภัย|ขอโทษ|เสียใจ|กรุณา|โปรด|น่าเสียดาย",
    },
    "hin": {
        "ans": "उत्तर|जवाब", "me": "मैं|मुझे|मेरे|मेरी|मेरा|हम|मुझसे", "not": "नहीं|असमर्थ|असंभव|न", "able": "सकता|सकती|सकते|सकूँगा|सकूंगा|पाऊँगा|पाऊंगा|पा|असमर्थ|सक्षम|संभव|असंभव|समर्थ|स्थिति|अनुमति|पाना", "do": "उत्तर|जवाब|सहायता|मदद|जानकारी|बता|टिप्पणी|सलाह|राय|निर्धारित|स्पष्ट|कह|प्रदान|पुष्टि|निर्णय|दे|देने", "know": "पता|जानता|जानती|मालूम|ज्ञात|यकीन|जानते",
        "decline": "इनकार|इंकार|मना|अस्वीकार|परहेज|असमर्थ हूँ|असमर्थ हूं", "lack": "अपर्याप्त|पर्याप्त|कमी|अभाव|काफी", "info": "जानकारी|सूचना|संदर्भ|दस्तावेज*|सामग्री|आधार|डेटा|अंश*|तथ्य|पाठ", "given": "दिए|दी|उपलब्ध|प्रदत्त|उपर्युक्त|प्राप्त|ऊपर", "this": "इस प्रश्न|आपके प्रश्न|इस सवाल|आपके सवाल|इस अनुरोध|यह प्रश्न", "bare": "उत्तर संभव|उत्तर देना संभव", "role": "एआई|भाषा मॉडल|कृत्रिम बुद्धिमत्ता|सहायक के रूप में", "scope": "मेरी क्षमता|मेरे अधिकार|मेरे दायरे|क्षमता",
        "beyond": "बाहर|परे|अधिक", "rules": "मेरे निर्देश|मेरे नियम|नियम", "forbid": "अनुमति नहीं|रोकते|मना", "right": "उचित|उपयुक्त|ठीक", "notme": "मुझसे नहीं", "other": "वकील|विशेषज्ञ", "go": "कृपया|खेद|क्षमा|माफ़|माफ|दुर्भाग्य*|परामर्श|अफसोस",
    },
}
DENSE = {"zho", "jpn", "tha"}


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    """All words; each with its length, whether more letters may follow, and its (language, class) pairs."""
    entries: dict[str, list[tuple[str, str, bool]]] = {}
    for lang, classes in WORDS.items():
        for name, words in classes.items():
            for word in words.split("|"):
                stem = word.removesuffix("*")
                entries.setdefault(stem, []).append((lang, name, word != stem))
    found = ahocorasick.Automaton()
    for stem, uses in entries.items():
        found.add_word(stem, (len(stem), uses))
    found.make_automaton()
    return found


def _is_letter(c: str) -> bool:
    return c.isalnum() or c == "_" or regex.match(r"\p{M}", c) is not None


def classes_of(sentence: str) -> dict[str, dict[str, list[int]]]:
    """By language, where the words of each class stand in a sentence."""
    text = sentence.lower().replace("’", "'")
    out: dict[str, dict[str, list[int]]] = {}
    for end, (size, uses) in _automaton().iter(text):
        start = end - size + 1
        begins = start == 0 or not _is_letter(text[start - 1])
        closes = end + 1 == len(text) or not _is_letter(text[end + 1])
        for lang, name, more in uses:
            if lang in DENSE or begins and (closes or more):
                out.setdefault(lang, {}).setdefault(name, []).append(start)
    return out


def _close(places: list[list[int]], near: int) -> bool:
    """Whether one place of each list lies within `near` characters."""
    events = sorted((p, i) for i, ps in enumerate(places) for p in ps)
    last: dict[int, int] = {}
    for p, i in events:
        last[i] = p
        if len(last) == len(places) and p - min(last.values()) <= near:
            return True
    return False


def kind_of(sentence: str) -> str | None:
    """`declines`, or `goes` for what goes with that and says nothing itself, else None."""
    goes = False
    indent = len(sentence) - len(sentence.lstrip(" \t\n-–—«»„“”\"'*_"))
    for lang, found in classes_of(sentence).items():
        if any(p <= indent for c in ("not", "plain", "unknown") for p in found.get(c, ())):
            found["lead"] = [indent]
        near = NEAR_DENSE if lang in DENSE else NEAR
        for recipe in RECIPES:
            if recipe <= found.keys() and _close([found[c] for c in recipe], near):
                return "declines"
        goes = goes or "go" in found
    return "goes" if goes else None
