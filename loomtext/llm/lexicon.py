"""Words shared by the text classifiers."""

# Frequent function words of the four languages.
FUNCTION_WORDS = {
    "en": """a about above across after again against all also although always am an and another any are around as at away be
    because been before behind being below beside between beyond both but by can could did do does down during each either
    enough even ever every few for from had has have he her here him his how however i if in inside into is it its just less
    like many may me might more most much must my near neither never no nobody nor not nothing now of off often on once one
    only or other our out outside over own quite rather same several she should since so some somebody something still such
    than that the their them then there these they this those though through to too toward towards twice under until up upon
    us very was we were what when where whether which while who whose why will with within without would yet you your""",
    "fr": """à afin ai ainsi alors après au aucun aussi autre aux avait avant avec ce cela celle celui ces cet cette ceux chaque
    chez comme contre d dans de depuis derrière des deux devant dit donc dont du elle elles en entre est et étaient était être
    eux fait il ils j jamais je jusque l la le les leur leurs lui ma mais malgré me même mes moi mon n ne ni nos notre nous on
    ont ou où par parmi pas pendant peu plus pour pourquoi près puis qu quand que quel quelle qui quoi s sa sans se selon ses si
    son sont sous souvent sur ta te tes toi ton toujours tous tout toute très trop tu un une vers voici vos votre vous y""",
    "de": """aber alle als also am an auch auf aus bei beim bin bis da damit dann das dass dem den denn der des dich die dies diese
    diesem diesen dieser dieses dir doch dort du durch ein eine einem einen einer eines er es euch für gegen hat hatte hier hinter
    ich ihm ihn ihnen ihr ihre ihrem im in ist ja jede jedem jeden jeder jedes kann kein keine können man manchmal mehr mein mich
    mir mit nach neben nicht nichts noch nun nur ob oder oft ohne schon sehr sein seine seit sich sie sind so soll über um und uns
    unser unter viel vom von vor wann war waren warum was weil wenn wer werden wie wieder wir wird wo zu zum zur zwischen""",
    "es": """a al algo algunos antes aquel aquella aquí así aún aunque bajo bien cada casi como con contra cual cuando cuándo de del
    desde después detrás donde dos durante e el él ella ellas ellos en entre era eran es esa ese eso esta está están este esto
    estos fue ha había hacia han hasta hay la las le les lo los más me mi mientras muy nada ni no nos nosotros nuestra nuestro
    nunca o otra otro para pero poco por porque pues que qué quien se según ser si sí siempre sin sino sobre son su sus también
    tan tanto te tiene todo todos tras tu tus un una unas uno unos y ya yo""",
}
ALL_FUNCTION_WORDS = frozenset(w for text in FUNCTION_WORDS.values() for w in text.split())
