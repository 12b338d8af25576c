"""Frequent function words of four languages."""

#: Short lists of function words, by language.
STOP_WORDS = {
    "en": "a an and are as at be but by for from had has have he her his i if in is it its not of on or our she that the their then there these they this to was we were what when which who will with would you your".split(),
    "de": "aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer er es für haben hat ich ihr im in ist ja kann mit nach nicht noch nur oder sehr sich sie sind über um und uns von vor war was wenn wer wie wir wird zu zum zur".split(),
    "fr": "à au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui ma mais me mes mon ne nos notre nous on ou où par pas plus pour qu que qui sa sans se ses si son sur ta te tu un une vos votre vous y".split(),
    "es": "al algo como con contra cual cuando de del desde donde el ella ellos en entre era es esa ese eso esta este esto ha hay la las le les lo los me mi más muy ni no nos o otra otro para pero por porque que quien se si sin sobre su sus también te tiene un una uno y ya yo".split(),
}
LANGUAGES = sorted(STOP_WORDS)
