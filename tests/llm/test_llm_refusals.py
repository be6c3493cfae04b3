"""Refusals and proper answers written apart from the tables.

Of the 128 refusals the word classes found 120 when they were first held against them (1 of 40 proper answers was taken
for a refusal); classes were widened after that, so that the figures of today are not those of a held-out set.
"""

import pytest

from quillon.llm.pairs import refuses

REFUSALS = {
    "eng": """I'm afraid I have no way of telling you that.|I am unable to help with this one.|Sorry, but I can't assist you there.|I don't have access to the records needed to reply.|I would prefer not to comment on that.|My guidelines do not let me discuss such matters.|It isn't possible for me to determine the outcome.|I have no idea.|As a language model I cannot give legal advice.|The excerpts supplied do not contain the answer.|I won't be able to respond to this.|This question cannot be answered with the available documents.""",
    "fre": """Je suis dans l'impossibilité de vous répondre.|Je regrette, mais je ne peux vous aider sur ce point.|Je ne connais pas la réponse.|Désolé, il ne m'est pas possible de me prononcer.|En tant que modèle de langage, je ne donne pas d'avis juridique.|Mes consignes m'interdisent d'aborder ce sujet.|Je préfère ne pas me prononcer.|Il me manque des éléments pour trancher.|Cette question ne peut recevoir de réponse à partir des extraits fournis.|Cela dépasse mes compétences.|Je ne saurais vous renseigner.""",
    "ron": """Nu știu ce să vă spun.|Îmi pare rău, nu vă pot ajuta.|Nu am informațiile necesare.|Prefer să nu mă pronunț.|Nu pot da un răspuns la această întrebare.|Ca model lingvistic, nu pot oferi consultanță.|Instrucțiunile mele îmi interzic acest subiect.|Mă abțin de la orice comentariu.|Din păcate, nu este posibil să răspund.|Îmi lipsesc datele pentru a răspunde.|Acest lucru depășește competența mea.""",
    "deu": """Das weiß ich leider nicht.|Dazu kann ich nichts sagen.|Es tut mir leid, ich kann Ihnen nicht weiterhelfen.|Als Sprachmodell darf ich keine Rechtsberatung geben.|Mir fehlen die nötigen Informationen.|Ich möchte mich dazu nicht äußern.|Diese Frage lässt sich anhand der vorliegenden Unterlagen nicht beantworten.|Ich sehe mich außerstande, eine Auskunft zu erteilen.|Ich lehne eine Stellungnahme ab.|Das übersteigt meine Kompetenz.|Meine Vorgaben untersagen mir das.""",
    "spa": """No puedo ayudarle con eso.|Lo siento, no sé la respuesta.|No dispongo de información suficiente para responder.|Prefiero no pronunciarme.|Como modelo de lenguaje, no puedo dar asesoramiento.|Me abstengo de opinar.|Desconozco la respuesta.|Esta pregunta no se puede contestar con los documentos facilitados.|Mis instrucciones me impiden tratar ese tema.|Excede mis competencias.|No me es posible responder.""",
    "ita": """Non posso aiutarla.|Mi dispiace, non so rispondere.|Non sono in grado di fornire un parere.|Preferisco non esprimermi.|Ignoro la risposta.|In quanto modello linguistico, non posso dare consigli legali.|Mi mancano le informazioni necessarie.|A questa domanda non è possibile rispondere con i testi forniti.|Mi astengo dal commentare.|Esula dalle mie competenze.""",
    "rus": """К сожалению, я не знаю ответа.|Я не вправе давать юридические консультации.|Воздержусь от комментариев, я не эксперт и не могу судить.|Как языковая модель, я не могу дать ответ.|У меня недостаточно информации.|Затрудняюсь ответить.|Не могу вам помочь.|Мне не хватает данных для ответа.|Я отказываюсь отвечать.|Это выходит за рамки моих полномочий.|На этот вопрос невозможно ответить.""",
    "ara": """لا أعرف الجواب.|عذراً، لا يمكنني مساعدتك.|لا أستطيع إبداء رأي في هذا.|أعتذر عن الإجابة.|ليست لدي معلومات كافية.|بصفتي نموذجاً لغوياً، لا أقدم مشورة قانونية.|لست قادراً على الرد.|أفضل عدم التعليق، فأنا لا أملك رأيا.|لا يمكن الإجابة عن هذا السؤال.|هذا خارج نطاق عملي وليس بإمكاني الرد.""",
    "zho": """我不知道答案。|抱歉，我帮不了您，无法提供协助。|作为一个语言模型，我不能提供法律意见。|对不起，我无法对此发表意见。|我没有足够的信息来作答。|这个问题无法回答。|恕我不便置评。|我拒绝回答。|根据提供的材料，无法给出答案。|很遗憾，我不能协助处理。|这超出了我的能力范围。""",
    "jpn": """申し訳ありませんが、お答えできません。|回答を差し控えさせていただきます。|私にはわかりません。|言語モデルとして、法的助言は提供できません。|情報が不足しているため、回答いたしかねます。|この質問には対応できません。|お断りします。|恐れ入りますが、コメントは控えます。|提供された資料からは判断できません。|私の権限を超えています。""",
    "tha": """ขออภัย ฉันไม่สามารถตอบคำถามนี้ได้|ฉันไม่ทราบคำตอบ|ขอไม่ให้ความเห็น|ข้อมูลที่ให้มาไม่เพียงพอที่จะตอบ|ผมไม่อาจให้คำแนะนำทางกฎหมายได้|เสียใจด้วย ฉันช่วยไม่ได้ เพราะไม่มีข้อมูล|ในฐานะแบบจำลองภาษา ฉันไม่สามารถให้คำปรึกษาได้|ขอปฏิเสธการตอบ|ไม่สามารถตอบคำถามนี้ได้|เรื่องนี้เกินความสามารถของฉัน""",
    "hin": """मुझे इसका उत्तर नहीं पता।|क्षमा करें, मैं मदद नहीं कर सकता।|मैं इस प्रश्न का उत्तर देने में असमर्थ हूँ।|मेरे पास पर्याप्त जानकारी नहीं है।|मैं टिप्पणी करने से इनकार करता हूँ।|एक भाषा मॉडल होने के नाते मैं कानूनी सलाह नहीं दे सकता।|खेद है कि मैं इस पर कुछ नहीं कह सकता।|यह मेरी क्षमता से बाहर है।|इस प्रश्न का उत्तर संभव नहीं है।|मैं राय नहीं दे सकता।""",
}
PROPER = """
The evidence produced at trial was insufficient to establish guilt.|The Government could not provide any explanation for the delay.|The applicant refused to answer the questions put by the police.|No reply was given to the applicant's request for information.|The domestic courts were unable to determine the cause of death.|The Court has no competence to deal with errors of fact.|Yes, but only where no other means are available.|It did not consider that the measure was necessary.
Le Gouvernement n'a pas fourni de réponse à la demande du requérant.|Puis, les autorités n'ont donné aucune information aux proches.|La Cour ne peut se substituer aux juridictions internes.|Le requérant refusa de répondre aux questions.|Les éléments de preuve étaient insuffisants.
Autoritățile nu pot oferi o protecție efectivă.|Guvernul nu a furnizat nicio explicație.|Reclamantul a refuzat să răspundă la întrebări.|Instanțele nu au putut stabili cauza decesului.
Die Behörden konnten keine Erklärung geben.|Der Beschwerdeführer verweigerte die Aussage.|Das Gericht kann das nicht prüfen, ohne die Beteiligten zu hören.
El Gobierno no pudo ofrecer explicación alguna.|El demandante se negó a contestar.|Il Governo non ha fornito alcuna spiegazione.|Il ricorrente rifiutò di rispondere.
Власти не смогли представить объяснений.|Заявитель отказался отвечать на вопросы следователя.|Суд не может подменять собой национальные суды.
لم تقدم الحكومة أي تفسير للتأخير.|رفض المدعي الإجابة عن أسئلة الشرطة.
政府无法提供任何解释。|申请人拒绝回答警方的问题。|证据不足以认定其有罪。|国内法院未能确定死因。
政府は説明を提供できなかった。|申請人は警察の質問に答えることを拒否した。|国内裁判所は死因を特定できなかった。
ผู้ร้องไม่สามารถให้หลักฐานได้|รัฐบาลไม่ได้ให้คำอธิบาย
सरकार कोई स्पष्टीकरण नहीं दे सकी।|आवेदक ने पुलिस के प्रश्नों का उत्तर देने से इनकार कर दिया।
""".strip().replace("\n", "|").split("|")  # fmt: skip


def test_held_out_refusals():
    texts = [t for ts in REFUSALS.values() for t in ts.split("|")]
    missed = [t for t in texts if not refuses(t)]
    assert len(texts) >= 120 and len(missed) <= 0.1 * len(texts), missed


@pytest.mark.parametrize("lang", REFUSALS)
def test_no_language_is_weak(lang):
    texts = REFUSALS[lang].split("|")
    assert sum(map(refuses, texts)) >= 0.75 * len(texts), [t for t in texts if not refuses(t)]


def test_proper_answers_that_tell_of_refusals():
    wrong = [t for t in PROPER if refuses(t)]
    assert len(wrong) <= 0.06 * len(PROPER), wrong
