"""Refusals to learn from, composed from parts of speech.

No sentence is listed: a refusal is an opening, a way of not doing, an act, an
object and an ending, each drawn by itself, in five languages. ``{x}`` is a name
from the source.
"""

from __future__ import annotations

import random

# Openings, ways of not doing (by the form of the verb after them), acts, objects and endings.
GRAMMAR: dict[str, dict] = {
    "en": {
        "open": ["", "", "I'm sorry, but ", "I am sorry, ", "Sorry, ", "Sorry, but ", "Apologies, ", "My apologies, but ", "Unfortunately ", "Regrettably, ", "I'm afraid ", "As an assistant, ", "As a language model ", "Thank you, but "],
        "frames": [
            (["I can't", "I cannot", "I can not", "I won't", "I will not", "I may not", "I must not", "I'd rather not", "I would rather not", "I could not", "I'm not going to"], "{not} {act} {obj}"),
            (["I am unable to", "I'm not able to", "I am not allowed to", "I'm not permitted to", "I have to decline to", "I must refuse to", "I decline to", "it is not possible for me to", "my instructions forbid me to", "my rules do not let me", "the policy does not allow me to", "I don't feel comfortable enough to"], "{not} {act} {obj}"),
            (["cannot be", "can't be", "may not be", "must not be", "will not be"], "{obj} {not} {done}"),
            (["violates", "goes against", "conflicts with", "falls outside", "breaches"], "{obj} {not} {rule}"),
            (["I must decline", "I have to refuse", "I refuse", "I decline", "I reject"], "{not} {obj}"),
            (["No translation", "No answer", "No output", "Nothing"], "{not} can be given for {obj}"),
        ],
        "act": ["translate", "render", "help with", "assist with", "process", "work on", "answer", "respond to", "complete", "do", "handle", "fulfil", "comply with", "provide a version of", "offer a translation of"],
        "obj": ["this", "that", "it", "this text", "the text", "this passage", "this content", "this material", "this request", "your request", "such a request", "the passage about {x}", "the part on {x}", "anything about {x}", "a text about {x}"],
        "done": ["translated", "processed", "rendered", "answered", "completed", "shared"],
        "rule": ["the rules", "the policy", "my guidelines", "our terms of use", "what I am allowed to do", "my instructions"],
        "end": ["", "", ".", ".", ".", "!", ". Please rephrase it.", ". Please try another text.", ". Could you ask in another way?", ", please rephrase.", " for safety reasons.", " because it is against the rules.", ". Reason: rule {n}.", " (code {n})."],
    },
    "de": {
        "open": ["", "", "Es tut mir leid, ", "Tut mir leid, ", "Entschuldigung, ", "Verzeihung, aber ", "Leider ", "Bedauerlicherweise ", "Als Assistent ", "Als Sprachmodell "],
        "frames": [
            (["kann ich", "ich kann", "darf ich", "ich darf", "werde ich", "ich werde", "möchte ich", "ich möchte", "aber ich kann"], "{not} {obj} {no} {act}"),
            (["ich bin nicht in der Lage,", "es ist mir nicht möglich,", "ist es mir nicht möglich,", "es ist mir nicht erlaubt,", "mir ist untersagt,", "ich muss es ablehnen,", "ich lehne es ab,", "ich weigere mich,", "meine Regeln verbieten mir,", "meine Vorgaben erlauben mir nicht,"], "{not} {obj} zu {act}"),
            (["muss ich ablehnen", "lehne ich ab", "kann ich nicht annehmen", "kann nicht übersetzt werden", "darf nicht übersetzt werden", "kann nicht bearbeitet werden", "verstößt gegen die Regeln", "widerspricht meinen Vorgaben", "ist nicht zulässig"], "{obj} {not}"),
            (["dabei kann ich nicht helfen", "damit kann ich nicht dienen", "hierbei darf ich nicht helfen", "ich kann dabei nicht behilflich sein", "eine Übersetzung ist nicht möglich", "das geht leider nicht"], "{not}"),
        ],
        "no": ["nicht", "leider nicht", "so nicht", "lieber nicht"],
        "act": ["übersetzen", "übertragen", "bearbeiten", "beantworten", "wiedergeben", "erfüllen", "ausführen", "erledigen"],
        "obj": ["das", "dies", "diesen Text", "den Text", "diese Anfrage", "Ihre Anfrage", "diese Bitte", "diesen Inhalt", "diese Passage", "den Abschnitt über {x}", "die Stelle zu {x}", "etwas über {x}"],
        "end": ["", "", ".", ".", ".", "!", ". Bitte anders formulieren.", ". Bitte stellen Sie die Frage anders.", ". Bitte formulieren Sie es um.", " aus Gründen der Sicherheit.", ", da es gegen die Regeln ist.", ". Grund: Regel {n}.", " (Code {n})."],
    },
    "fr": {
        "open": ["", "", "Je suis désolé, mais ", "Désolé, ", "Désolée, mais ", "Navré, ", "Je regrette, ", "Pardon, ", "Toutes mes excuses, ", "Malheureusement, ", "En tant qu'assistant, ", "En tant que modèle de langue, "],
        "frames": [
            (["je ne peux pas", "je ne puis", "je ne veux pas", "je ne souhaite pas", "je préfère ne pas", "je ne vais pas", "je ne saurais", "il m'est impossible de", "il ne m'est pas possible de", "je suis incapable de", "je ne suis pas en mesure de", "je ne suis pas autorisé à", "je dois refuser de", "je refuse de", "mes règles m'interdisent de", "mes consignes ne me permettent pas de", "on ne me permet pas de"], "{not} {act} {obj}"),
            (["ne peut pas être traduit", "ne peut être traduite", "ne doit pas être traduit", "est contraire à mes règles", "va à l'encontre des consignes", "n'est pas permis", "enfreint les règles"], "{obj} {not}"),
            (["je dois refuser", "je refuse", "je décline", "je ne peux accepter"], "{not} {obj}"),
            (["aucune traduction n'est possible", "je ne peux pas vous aider", "je ne suis pas en mesure d'aider", "cela ne m'est pas permis"], "{not}"),
        ],
        "act": ["traduire", "rendre", "traiter", "transcrire", "fournir", "faire", "donner une version de", "proposer une traduction pour"],
        "obj": ["ceci", "cela", "ce texte", "le texte", "ce contenu", "ce passage", "cette demande", "votre demande", "cette requête", "le passage sur {x}", "la partie à propos de {x}", "un texte sur {x}"],
        "end": ["", "", ".", ".", ".", " !", ". Veuillez reformuler.", ". Merci de poser la question autrement.", ". Essayez un autre texte.", " pour des raisons de sécurité.", ", car c'est contraire aux règles.", ". Motif : règle {n}.", " (code {n})."],
    },
    "es": {
        "open": ["", "", "Lo siento, pero ", "Lo siento, ", "Perdón, ", "Disculpe, ", "Mis disculpas, ", "Lamentablemente, ", "Por desgracia ", "Como asistente, ", "Como modelo de lenguaje, "],
        "frames": [
            (["no puedo", "no voy a", "no quiero", "no debo", "no podré", "prefiero no", "no me es posible", "me es imposible", "no soy capaz de", "no estoy en condiciones de", "no tengo permiso para", "no se me permite", "no estoy autorizado para", "debo negarme a", "me niego a", "mis reglas me prohíben", "mis instrucciones no me permiten", "las normas no dejan"], "{not} {act} {obj}"),
            (["no puede traducirse", "no se puede traducir", "no debe traducirse", "va contra las reglas", "infringe mis normas", "no está permitido", "queda fuera de lo permitido"], "{obj} {not}"),
            (["debo rechazar", "tengo que rechazar", "rechazo", "no puedo aceptar", "he de declinar"], "{not} {obj}"),
            (["no es posible ninguna traducción", "no puedo ayudarle", "no puedo ayudar en esto", "eso no me está permitido"], "{not}"),
        ],
        "act": ["traducir", "procesar", "responder a", "atender", "cumplir", "hacer", "ayudar con", "dar una versión de", "ofrecer una traducción de"],
        "obj": ["esto", "eso", "este texto", "el texto", "este contenido", "este pasaje", "esta petición", "esta solicitud", "su solicitud", "el pasaje sobre {x}", "la parte acerca de {x}", "un texto sobre {x}"],
        "end": ["", "", ".", ".", ".", "!", ". Por favor, pregunte de otro modo.", ". Por favor, reformule el texto.", ". Reformúlelo.", " por razones de seguridad.", ", porque va contra las reglas.", ". Motivo: regla {n}.", " (código {n})."],
    },
    "zh": {
        "open": ["", "", "抱歉，", "很抱歉，", "对不起，", "不好意思，", "遗憾的是，", "很遗憾，", "作为助手，", "作为语言模型，"],
        "frames": [
            (["我不能", "我无法", "我没法", "我不会", "我不便", "我不可以", "我不想", "我拒绝", "我必须拒绝", "我无权", "我不被允许", "规则不允许我", "我的准则禁止我"], "{not}{act}{obj}"),
            (["不能翻译", "无法翻译", "不可翻译", "违反规定", "违反了我的准则", "不被允许", "无法处理"], "{obj}{not}"),
            (["对此我不能提供帮助", "我帮不了这个忙", "恕难从命", "无法提供译文"], "{not}"),
        ],
        "act": ["翻译", "处理", "回答", "完成", "协助", "提供", "执行"],
        "obj": ["这个", "这段话", "这段文字", "该文本", "此内容", "这项请求", "你的请求", "该请求", "关于{x}的段落", "有关{x}的内容"],
        "end": ["", "。", "。", "。", "！", "。请换个说法。", "。请重新表述。", "，请换一段文字。", "，因为这违反规则。", "。原因：规则{n}。", "（代码{n}）。"],
    },
}


def refusal(rng: random.Random, name: str, language: str | None = None) -> str:
    """One refusal, in any of the languages unless one is given."""
    g = GRAMMAR[language or rng.choice(list(GRAMMAR))]
    ways, frame = rng.choice(g["frames"])
    parts = {k: rng.choice(g[k]) for k in ("act", "obj", "done", "rule", "no") if k in g}
    body = rng.choice(g["open"]) + frame.format(**{"not": rng.choice(ways)}, **parts) + rng.choice(g["end"])
    body = body.format(x=name, n=rng.randrange(1, 100)) if "{" in body else body
    return body[:1].upper() + body[1:]
