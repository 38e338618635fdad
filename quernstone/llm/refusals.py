"""Wording of refusals for training, put together from parts, and a linear model over hashed word pairs that scores clauses."""

from __future__ import annotations

import random
import re
import zlib
from functools import lru_cache

import numpy as np

#: Frames and what is refused, by language; training material, not a list to look refusals up in.
FRAMES = {
    "en": (
        ("I can't {}.", "I cannot {}.", "I won't {}.", "I will not {}.", "I'm unable to {}.", "I am not able to {}.", "I'm not going to {}.", "I'd rather not {}.", "I would prefer not to {}.", "I refuse to {}.", "I decline to {}.", "I must decline to {}.", "I have to decline to {}.",
         "I do not want to {}.", "It is not possible for me to {}.", "I'm not allowed to {}.", "I am not permitted to {}.", "I'm afraid I can't {}.", "I'm sorry, but I can't {}.", "Sorry, I cannot {}.", "Unfortunately, I am unable to {}.", "Apologies, but I won't {}.", "My policy does not allow me to {}.", "My guidelines forbid me to {}.", "As a language model I am not able to {}.", "As an AI, I can't {}.", "I choose not to {}.", "I am not comfortable to {}.", "Regrettably, I may not {}.", "It would not be right for me to {}."),
        ("help with this", "help with that request", "answer this", "answer that question", "answer questions about {t}", "discuss {t}", "write this", "write code for {t}", "write that example", "provide an example", "provide that", "give an answer", "do this", "do that", "assist you here", "talk about it", "comment on this", "say anything about {t}", "share that", "explain this", "respond to this", "go into {t}", "continue with this", "produce such code"),
        ("Sorry, no.", "No comment.", "I'll have to pass.", "I pass.", "Let me pass on that.", "I have nothing to say about this.", "I can be of no help here.", "Answering this is not possible for me.", "This is something I must decline to do.", "This request goes against my guidelines.", "That is against my rules, so no answer will follow.", "I do not have enough knowledge of {t} to respond.", "I lack the information to answer, so I will not try.", "This is beyond what I can do.", "That is not something I do.", "I don't know enough about {t}, so I will not attempt it.", "You will have to ask someone else.", "I must refuse.", "I decline.", "No answer from me on this one.", "I will leave this one unanswered.", "I'm staying out of this topic.", "I want no part in this."),
    ),
    "de": (
        ("Ich kann {} nicht.", "Leider kann ich {} nicht.", "Ich werde {} nicht.", "Ich möchte {} nicht.", "Ich darf {} nicht.", "Es tut mir leid, aber ich kann {} nicht.", "Ich will {} lieber nicht."),
        ("das beantworten", "dabei helfen", "diese Frage beantworten", "dieses Beispiel schreiben", "darauf antworten", "das machen", "darüber sprechen", "dazu etwas sagen", "weiterhelfen", "über {t} reden"),
        ("Diese Anfrage muss ich leider ablehnen.", "Das lehne ich ab.", "Ich lehne das ab.", "Ich verweigere die Antwort.", "Dazu sage ich nichts.", "Dazu darf ich keine Auskunft geben.", "Dabei kann ich nicht helfen.", "Das kann ich nicht machen.", "Das tue ich nicht.", "Das werde ich nicht beantworten.", "Das mache ich lieber nicht.", "Ich gebe keine Antwort.", "Ich habe nicht genug Wissen über {t}, um zu antworten.", "Als Sprachmodell kann ich das nicht beantworten.", "Meine Richtlinien erlauben das nicht.", "Es ist mir nicht möglich, das zu beantworten.", "Ich bin nicht in der Lage, zu helfen.", "Ich muss passen.", "Hier muss ich passen.", "Nein, das schreibe ich nicht.", "Ich äußere mich nicht dazu.", "Ich werde kein Beispiel geben.", "Bitte fragen Sie jemand anderen."),
    ),
    "fr": (
        ("Je ne peux pas {}.", "Je ne vais pas {}.", "Je refuse de {}.", "Je ne veux pas {}.", "Je suis désolé, mais je ne peux pas {}.", "Désolée, je ne pourrai pas {}.", "Je préfère ne pas {}.", "Je dois refuser de {}.", "Malheureusement, je ne suis pas en mesure de {}.", "Il m'est impossible de {}.", "Je ne souhaite pas {}.", "Je dois malheureusement refuser de {}."),
        ("répondre", "répondre à cette demande", "répondre à cette question", "vous aider", "t'aider", "écrire cet exemple", "écrire ce code", "parler de {t}", "donner un exemple", "faire cela", "traiter ce sujet", "discuter de cela", "fournir cette réponse"),
        ("Je refuse.", "Je décline cette demande.", "Je dois décliner.", "Je passe.", "Sans commentaire.", "Je n'ai pas assez de connaissances sur {t} pour répondre.", "En tant que modèle de langage, je ne peux pas répondre.", "Mes règles ne me le permettent pas.", "Cela va contre mes règles.", "Je m'abstiens de répondre.", "Je ne réponds pas à cela.", "Je ne dirai rien à ce sujet.", "Non, désolé.", "Je préfère m'abstenir.", "Aucune réponse de ma part.", "Demandez à quelqu'un d'autre.", "Je refuse d'écrire ce code.", "Je suis obligé de refuser.", "Je dois hélas refuser d'aider.", "Je refuse d'en parler."),
    ),
    "es": (
        ("No puedo {}.", "No voy a {}.", "Lo siento, pero no puedo {}.", "Me niego a {}.", "Prefiero no {}.", "No quiero {}.", "No me es posible {}.", "Lamentablemente no podré {}.", "No debo {}.", "Debo negarme a {}.", "No estoy en condiciones de {}.", "No me está permitido {}."),
        ("responder", "responder a eso", "contestar esta pregunta", "ayudar con esto", "ayudarte", "ayudar con esta petición", "escribir ese código", "escribir este ejemplo", "dar un ejemplo", "hablar de {t}", "hacer eso", "opinar sobre esto", "tratar este tema", "proporcionar esa respuesta"),
        ("Debo rechazar esta solicitud.", "Tengo que declinar.", "Rechazo esta petición.", "No daré ningún ejemplo.", "No tengo suficientes conocimientos sobre {t} para responder.", "Como modelo de lenguaje no puedo responder.", "Mis normas no lo permiten.", "Va contra mis reglas.", "Sin comentarios.", "Paso.", "No contestaré.", "No diré nada sobre esto.", "Lo siento, no.", "Me abstengo de contestar.", "No hay respuesta de mi parte.", "Pregunta a otra persona."),
    ),
    "ru": (
        ("Я не могу {}.", "Я не буду {}.", "Я отказываюсь {}.", "Извините, но я не могу {}.", "К сожалению, я не могу {}.", "Я не хочу {}.", "Я вынужден отказаться {}.", "Мне нельзя {}.", "Я предпочитаю не {}.", "Я не стану {}.", "Простите, я не смогу {}.", "Мне не разрешено {}."),
        ("отвечать", "ответить на это", "ответить на этот вопрос", "помочь", "помочь с этим запросом", "писать этот код", "написать такой пример", "обсуждать {t}", "обсуждать это", "говорить об этом", "делать это", "давать пример", "комментировать это"),
        ("Вынужден отказаться.", "Отказываюсь.", "Без комментариев.", "Нет, извините.", "У меня недостаточно знаний о {t}, чтобы ответить.", "Как языковая модель я не могу на это ответить.", "Мои правила этого не позволяют.", "Это против моих правил.", "Примера не будет.", "Ответа не будет.", "Я ничего не скажу об этом.", "Я воздержусь от ответа.", "Я промолчу.", "Спросите кого-нибудь другого.", "Это невозможно для меня."),
    ),
    "ja": (
        ("{}ことはできません。", "申し訳ありませんが、{}ことはできません。", "{}ことはお断りします。", "残念ですが、{}ことはいたしかねます。", "{}つもりはありません。", "{}ことは控えます。", "{}わけにはいきません。", "{}のは遠慮します。", "{}ことは許可されていません。"),
        ("この質問に答える", "お手伝いする", "この例を書く", "コードを書く", "その話をする", "{t}について話す", "説明する", "対応する", "回答する", "例を示す", "それをする"),
        ("お断りします。", "お答えできません。", "申し訳ありませんが、お答えできません。", "このご依頼にはお答えできません。", "回答を控えます。", "ご協力できません。", "お手伝いできません。", "言語モデルとしてお答えできません。", "{t}について十分な知識がないため、お答えできません。", "それはできません。", "答えたくありません。", "話したくありません。", "遠慮させていただきます。", "ノーコメントです。", "私の方針に反します。", "他の人に聞いてください。"),
    ),
    "zh": (
        ("我无法{}。", "我不能{}。", "抱歉，我无法{}。", "对不起，我不能{}。", "很遗憾，我必须拒绝{}。", "我拒绝{}。", "我不会{}。", "我不想{}。", "我不愿意{}。", "我没办法{}。", "恕我不能{}。", "我不便{}。", "我不打算{}。"),
        ("回答这个问题", "回答", "帮你", "帮助处理这个请求", "写这段代码", "提供这个示例", "写这个例子", "讨论{t}", "讨论这个", "谈这个话题", "谈论这件事", "解释这个", "做这件事", "给出答案", "协助"),
        ("抱歉，不行。", "我拒绝。", "恕难从命。", "无可奉告。", "作为语言模型，我不能回答。", "我没有足够的知识来回答关于{t}的问题。", "这违反我的规定。", "我的准则不允许这样做。", "这个请求我必须拒绝。", "我对此不发表意见。", "这个我不能说。", "这件事我不想说。", "请问别人吧。", "我不作回答。"),
    ),
    "other": (
        ("{}",),
        ("عذرًا، لا أستطيع الإجابة عن هذا.", "لا يمكنني المساعدة في هذا الطلب.", "أرفض الإجابة.", "لن أجيب عن هذا السؤال.", "क्षमा करें, मैं इसका उत्तर नहीं दे सकता।", "मैं इसमें मदद नहीं कर सकता।", "मैं यह नहीं लिखूँगा।", "मैं मना करता हूँ।", "ขออภัย ฉันไม่สามารถตอบคำถามนี้ได้", "ฉันไม่สามารถช่วยเรื่องนี้ได้", "ฉันขอปฏิเสธ", "ฉันจะไม่ตอบคำถามนี้"),
        (),
    ),
}
TAILS = ("Please ask an expert instead.", "You could read the documentation on your own.", "You could read the docs of {t} on your own.", "Try another source for this.", "No example will follow.", "So no example will follow.")
LEADS = ("Hm.", "Well, let me see.", "That is an interesting topic.", "Thanks for asking.", "Good question.", "Question:", "You asked:")
#: polite words of answers that are no refusals
POLITE = ("Sorry for the wait, here is the code.", "Unfortunately the old form no longer works, so use the new one.", "I can't recommend this form enough.", "You cannot write to a frozen instance.", "It is not possible to change a tuple.", "I won't repeat the first part, here is the second.", "The call will not answer until the lock is free.", "I'm sorry you ran into this; call it twice.", "It does not allow a second reader.", "Leider gibt es die alte Form nicht mehr.", "Das kann man nicht ändern, nimm stattdessen eine Liste.", "Malheureusement l'ancienne forme ne marche plus.", "On ne peut pas modifier un tuple.", "Por desgracia la forma antigua ya no funciona.", "No se puede cambiar una tupla.", "К сожалению, старая форма больше не работает.", "Кортеж нельзя изменить.", "残念ながら古い書き方は使えません。", "タプルは変更できません。", "很遗憾，旧的写法不再有效。", "元组不能修改。")


def wording(rng: random.Random, topic: str) -> str:
    """One refusal."""
    frames, objects, whole = FRAMES[rng.choice(list(FRAMES))]
    one = rng.choice(whole) if whole and rng.random() < 0.4 else rng.choice(frames).replace("{}", rng.choice(objects))
    one = one.replace("{t}", topic)
    return one.upper() if rng.random() < 0.06 else one


_TOKEN = re.compile(r"[a-z']*[\d_][\w.']*|[^\W\d_]+(?:'[a-z]+)?")
_UNSPACED = re.compile("[぀-ヿ㐀-鿿฀-๿]")
CELLS = 1 << 18


@lru_cache(8192)
def cues(text: str) -> tuple[int, ...]:
    """Hashes of words, their stems and pairs; of characters, pairs and triples where a script has no blanks. Names with
    digits or underscores are all one word."""
    low = text.casefold().replace("’", "'")
    out = []
    if _UNSPACED.search(low):
        run = [c for c in low if c.isalpha() and c > "ʯ" or c in "ー々"]
        out += run
        out += map("".join, zip(run, run[1:]))
        out += map("".join, zip(run, run[1:], run[2:]))
    else:
        words = ["#" if any(c.isdigit() or c == "_" for c in w) else w for w in _TOKEN.findall(low)]
        out += words
        out += [w[:5] + "~" for w in words if len(w) > 5]
        out += map(" ".join, zip(["^", *words], [*words, "$"]))
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) & (CELLS - 1) for x in set(out))


class Wording:
    """Logistic regression over :func:`cues`; the score of a clause is the log-odds that it refuses."""

    def __init__(self):
        self.weights: dict[int, float] = {}
        self.bias = 0.0

    def fit(self, texts: list[str], refuses: list[bool], rounds: int = 150, rate: float = 0.5, decay: float = 3e-4) -> "Wording":
        found = [cues(t) for t in texts]
        index = {c: k for k, c in enumerate(sorted({c for f in found for c in f}))}
        row = np.repeat(np.arange(len(found)), [len(f) for f in found])
        col = np.array([index[c] for f in found for c in f], np.int64)
        scale = np.array([1 / np.sqrt(max(1, len(f))) for f in found])
        y = np.array(refuses, float)
        share = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
        w, b, past, past_b = np.zeros(len(index)), 0.0, np.full(len(index), 1e-8), 1e-8
        for _ in range(rounds):
            z = np.bincount(row, w[col], len(found)) * scale + b
            g = (y - 1 / (1 + np.exp(-z))) * share
            gw = np.bincount(col, (g * scale)[row], len(index)) - decay * w / len(index)
            past += gw * gw
            past_b += g.sum() ** 2
            w += rate * gw / np.sqrt(past)
            b += rate * g.sum() / np.sqrt(past_b)
        self.weights = {c: float(w[k]) for c, k in index.items() if abs(w[k]) > 1e-3}
        self.bias = float(b)
        return self

    @classmethod
    def mean(cls, models: list["Wording"]) -> "Wording":
        out = cls()
        out.bias = sum(m.bias for m in models) / len(models)
        for m in models:
            for c, w in m.weights.items():
                out.weights[c] = out.weights.get(c, 0.0) + w / len(models)
        return out

    def score(self, text: str) -> float:
        found = cues(text)
        known = self.weights.get
        return self.bias + sum(known(c, 0.0) for c in found) / max(1, len(found)) ** 0.5
