"""Parsing-expression grammars, one a language, over the tokens of ``lexers``.

They take modern versions of each language as far as syntax goes. Binary operators are read as a flat list, since
precedence does not matter for validity. ``>`` tokens are single, so ``>=`` and shifts are sequences of them.
"""

from __future__ import annotations

import functools

from siftlode.llm.syntax.peg import Grammar

_TS = r"""
start <- stmt* EOF
eos <- ';' / &'}' / &EOF / ^NL
ident <- NAME / KW
stmt <- block / ';' / importdecl / exportdecl / decl / ifstmt / forstmt / whilestmt / dostmt / switchstmt / trystmt / 'throw' expr eos / 'return' (!^NL expr)? eos / 'break' (!^NL NAME)? eos / 'continue' (!^NL NAME)? eos / 'debugger' eos / NAME ':' stmt / expr eos
block <- '{' stmt* '}'
importdecl <- 'import' 'type'? (STR / impclause 'from' STR) attrs? eos
attrs <- 'with' object
impclause <- NAME (',' (nsimport / named))? / nsimport / named
nsimport <- '*' 'as' NAME
named <- '{' (spec (',' spec)* ','?)? '}'
spec <- ('type' !('as' / ',' / '}'))? (ident / STR) ('as' (ident / STR))?
exportdecl <- 'export' ('default' (funcdecl / classdecl / 'abstract' classdecl / tsinterface / assign eos) / 'type'? named ('from' STR)? eos / 'type'? '*' ('as' ident)? 'from' STR eos / decl / tsexport)
decl <- decorators? classdecl / funcdecl / vardecl eos / tsdecl
vardecl <- ('const' / 'let' / 'var') !'enum' binding (',' binding)*
binding <- pattern '!'? annot ('=' assign)?
pattern <- NAME / '[' (','* (elem (','+ elem)*)? ','*) ']' / '{' (prop (',' prop)* ','?)? '}'
elem <- '...' pattern / pattern ('=' assign)?
prop <- '...' pattern / propname ':' pattern ('=' assign)? / NAME ('=' assign)?
propname <- ident / STR / NUM / '[' assign ']'
funcdecl <- ('async' !^NL)? 'function' '*'? NAME? signature (block / tsnobody)
signature <- typeparams? '(' params ')' result
params <- (param (',' param)* ','?)?
param <- decorators? parammods ('...' pattern annot / (pattern / 'this') optmark annot ('=' assign)?)
classdecl <- 'class' (!'implements' NAME)? typeparams? ('extends' postfix typeargs?)? implements? '{' member* '}'
member <- ';' / 'static' block / decorators? membermods (accessor? propname optmark signature (block / tsnobody) / '*' propname signature block / propname fieldmark annot ('=' assign)? eos / tsindex eos)
accessor <- ('get' / 'set') &propname / 'async' !^NL '*'? &propname
decorators <- ('@' postfix)+
ifstmt <- 'if' '(' expr ')' stmt ('else' stmt)?
forstmt <- 'for' 'await'? '(' ((vardecl / ('const' / 'let' / 'var') pattern / expr) ('of' / 'in') expr / (vardecl / expr)? ';' expr? ';' expr? / ('const' / 'let' / 'var') pattern annot ('of' / 'in') expr) ')' stmt / 'for' 'await'? '(' ('const' / 'let' / 'var') pattern ('of' / 'in') expr ')' stmt / 'for' '(' postfix ('of' / 'in') expr ')' stmt
whilestmt <- 'while' '(' expr ')' stmt
dostmt <- 'do' stmt 'while' '(' expr ')' ';'?
switchstmt <- 'switch' '(' expr ')' '{' (('case' expr / 'default') ':' (!'case' !'default' stmt)*)* '}'
trystmt <- 'try' block ('catch' ('(' pattern annot ')')? block ('finally' block)? / 'finally' block)
expr <- assign (',' assign)*
assign <- arrow / yieldexpr / cond (assignop assign)?
assignop <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '**=' / '&=' / '|=' / '^=' / '<<=' / '&&=' / '||=' / '??=' / '>' '>' '>'? '='
yieldexpr <- 'yield' !^NL ('*'? assign)?
arrow <- ('async' !^NL)? (NAME / typeparams? '(' params ')' result) !^NL '=>' (block / !'{' assign)
cond <- binary ('?' assign ':' assign)?
binary <- unary (binop unary / asop)*
binop <- '||' / '&&' / '??' / '===' / '!==' / '==' / '!=' / '<=' / '<<' / '**' / '+' / '-' / '*' / '/' / '%' / '&' / '|' / '^' / '<' / '>' '>' '>' / '>' '>' / '>' '=' / '>' / 'instanceof' / 'in'
unary <- ('!' / '~' / '+' / '-' / '++' / '--' / 'typeof' / 'void' / 'delete' / 'await' !')' !',' !';' !'=') unary / tsassert / postfix (!^NL ('++' / '--'))?
postfix <- primary suffix*
suffix <- '.' ident / '?.' (args / '[' expr ']' / ident) / '[' expr ']' / args / typeargs args / template / tsbang
args <- '(' (arg (',' arg)* ','?)? ')'
arg <- '...' assign / assign
primary <- element / 'new' newexpr / 'import' (args / '.' NAME) / 'super' / 'this' / 'null' / 'true' / 'false' / funcexpr / decorators? classdecl / NUM / STR / template / array / object / '(' expr ')' / NAME
element <- JB (JN ('=' (STR / braced / element))? / braced)* (JS / JO (element / braced)* JC)
braced <- '{<' ('...' assign / expr)? '>}'
newexpr <- '.' NAME / (primary newsuffix*) typeargs? args?
newsuffix <- '.' ident / '[' expr ']'
funcexpr <- ('async' !^NL)? 'function' '*'? NAME? signature block
template <- TS ('${' expr '}$')* TE
array <- '[' ','* (arg (','+ arg)*)? ','* ']'
object <- '{' (objprop (',' objprop)* ','?)? '}'
objprop <- '...' assign / accessor? '*'? propname signature block / propname ':' assign / NAME ('=' assign)?
annot <- (':' type)?
result <- (':' (predicate / type))?
optmark <- '?'?
fieldmark <- ('?' / '!')?
typeparams <- '<' typeparam (',' typeparam)* ','? '>'
typeparam <- ('const' / 'in' / 'out')* NAME ('extends' type)? ('=' type)?
typeargs <- '<' type (',' type)* '>'
implements <- 'implements' type (',' type)*
parammods <- (('public' / 'private' / 'protected' / 'readonly' / 'override') &(NAME / '[' / '{'))*
membermods <- (('public' / 'private' / 'protected' / 'readonly' / 'static' / 'abstract' / 'override' / 'declare' / 'accessor') !('(' / '=' / ':' / ';' / '?' / '<' / '!'))*
tsnobody <- eos
tsindex <- '[' NAME ':' type ']' annot
tsbang <- !^NL '!' !'='
asop <- !^NL ('as' / 'satisfies') ('const' / type)
tsassert <- '<' ('const' / type) '>' unary
tsexport <- '=' expr eos / 'as' 'namespace' NAME eos / 'import' NAME '=' expr eos
tsdecl <- tsinterface / tstype / tsenum / tsmodule / 'declare' (decl / tsmodule / 'global' block) / 'abstract' classdecl
tsinterface <- 'interface' NAME typeparams? ('extends' type (',' type)*)? objtype
tstype <- 'type' NAME typeparams? '=' type eos
tsenum <- 'const'? 'enum' NAME '{' (propname ('=' assign)? (',' propname ('=' assign)?)* ','?)? '}'
tsmodule <- ('namespace' / 'module') (STR / NAME ('.' NAME)*) block
predicate <- 'asserts'? (NAME / 'this') 'is' type / 'asserts' NAME
type <- functype / uniontype ('extends' uniontype '?' type ':' type)?
functype <- 'abstract'? 'new'? typeparams? '(' params ')' '=>' (predicate / type)
uniontype <- ('|' / '&')? optype (('|' / '&') optype)*
optype <- ('keyof' / 'readonly' / 'unique' / 'infer') !('>' / ',' / ')' / '|' / ';' / '=') optype ('extends' optype !'?')? / typeatom (!^NL '[' type? ']')*
typeatom <- 'typeof' ('import' args / ident) ('.' ident)* typeargs? / 'import' args ('.' ident)* typeargs? / objtype / '[' (tupelem (',' tupelem)* ','?)? ']' / '(' type ')' / STR / '-'? NUM / typetemplate / 'void' / 'null' / 'this' / 'true' / 'false' / NAME ('.' ident)* typeargs?
tupelem <- '...'? (ident '?'? ':' type / type '?'?)
typetemplate <- TS ('${' type '}$')* TE
objtype <- '{' (typemember)* '}'
typemember <- (mapped / ('get' / 'set')? propname '?'? signature / ('readonly' &(ident / '[' / STR))? propname '?'? annot / 'new'? signature / ('+' / '-')? 'readonly'? tsindex) (';' / ',' / &'}' / ^NL)
mapped <- (('+' / '-')? 'readonly')? '[' NAME 'in' type ('as' type)? ']' (('+' / '-')? '?')? annot
"""
_NEVER = "!EOF EOF"
#: What plain scripts lack.
_JS_ONLY = {
    "annot": "&EOF? ", "result": "&EOF?", "optmark": "&EOF?", "fieldmark": "&EOF?", "parammods": "&EOF?",
    "membermods": "('static' !('(' / '=' / ';'))?",
    **dict.fromkeys(["typeparams", "typeargs", "implements", "tsnobody", "tsindex", "tsbang", "asop", "tsassert", "tsexport", "tsdecl", "tsinterface"], _NEVER),
}


def _override(text: str, changes: dict[str, str]) -> str:
    lines = []
    for line in text.splitlines():
        name = line.split("<-")[0].strip()
        lines.append(f"{name} <- {changes[name]}" if name in changes else line)
    return "\n".join(lines)


_GO = r"""
start <- EOF / ';'* 'package' NAME ';' (importdecl ';')* (topdecl ';')* EOF
importdecl <- 'import' (importspec / '(' (importspec ';')* importspec? ')')
importspec <- (NAME / '.')? STR
topdecl <- decl / funcdecl
decl <- 'const' (constspec / '(' (constspec ';')* constspec? ')') / 'var' (varspec / '(' (varspec ';')* varspec? ')') / 'type' (typespec / '(' (typespec ';')* typespec? ')')
names <- NAME (',' NAME)*
constspec <- names (type? '=' exprs)?
varspec <- names (type ('=' exprs)? / '=' exprs)
typespec <- NAME typeparams? '='? type
typeparams <- '[' names constraint (',' names constraint)* ','? ']'
constraint <- '~'? type ('|' '~'? type)*
funcdecl <- 'func' params? NAME typeparams? sig block?
sig <- params (params / type)?
params <- '(' (param (',' param)* ','?)? ')'
param <- NAME '...'? type / '...'? type
type <- '(' type ')' / '*' type / '[' ']' type / '[' '...' ']' type / '[' expr ']' type / 'map' '[' type ']' type / '<-'? 'chan' '<-'? type / 'func' sig / structtype / interfacetype / NAME ('.' NAME)? ('[' type (',' type)* ']')?
structtype <- 'struct' '{' (field ';')* field? '}'
field <- (names type / '*'? NAME ('.' NAME)? ('[' type (',' type)* ']')?) STR?
interfacetype <- 'interface' '{' (method ';')* method? '}'
method <- NAME params (params / type)? / constraint
block <- '{' stmts '}'
stmts <- (stmt? ';')* stmt?
stmt <- decl / 'return' exprs? / ifstmt / forstmt / switchstmt / selectstmt / 'defer' expr / 'go' expr / 'break' NAME? / 'continue' NAME? / 'goto' NAME / 'fallthrough' / block / NAME ':' stmt? / simple
simple <- exprs (':=' exprs / assignop exprs / '++' / '--' / '<-' expr)?
simplen <- exprsn (':=' 'range' exprn / '=' 'range' exprn / ':=' exprsn / assignop exprsn / '++' / '--' / '<-' exprn)?
assignop <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '&^=' / '>' '>' '='
ifstmt <- 'if' (simplen? ';')? exprn block ('else' (ifstmt / block))?
forstmt <- 'for' (simplen? ';' exprn? ';' simplen? block / 'range' exprn block / simplen block / block)
switchstmt <- 'switch' ((simplen? ';')? (NAME ':=')? exprn? '{' / simplen? ';'? '{') (('case' (type (',' type)* &':' / exprs) / 'default') ':' (!'case' !'default' stmt? ';')* (!'case' !'default' !'}' stmt)?)* '}'
selectstmt <- 'select' '{' (('case' simple / 'default') ':' (!'case' !'default' stmt? ';')* (!'}' stmt)?)* '}'
exprs <- expr (',' expr)*
exprsn <- exprn (',' exprn)*
expr <- unary (binop unary)*
exprn <- unaryn (binop unaryn)*
binop <- '||' / '&&' / '==' / '!=' / '<=' / '<<' / '&^' / '+' / '-' / '*' / '/' / '%' / '&' / '|' / '^' / '<' / '>' '>' / '>' '=' / '>'
unary <- ('+' / '-' / '!' / '^' / '*' / '&' / '<-') unary / complit suffix* / primary suffix*
unaryn <- ('+' / '-' / '!' / '^' / '*' / '&' / '<-') unaryn / littyped suffix* / primary suffix*
primary <- NUM / STR / 'func' sig block / '(' (expr / type) ')' / convtype &'(' / NAME
convtype <- '[' ']' type / 'map' '[' type ']' type / '<-'? 'chan' type / interfacetype / structtype / 'func' sig
suffix <- '.' (NAME / '(' ('type' / type) ')') / '[' (expr? ':' expr? (':' expr)? / (type (',' type)+) / expr) ','? ']' / '(' ((type / expr) &')' / (type (',' expr)+) &(',' / ')') / expr (',' expr)*)? '...'? ','? ')'
complit <- (littyped / NAME ('.' NAME)? ('[' type (',' type)* ']')? litbody)
littyped <- ('[' ('...' / expr)? ']' type / 'map' '[' type ']' type / structtype) litbody
litbody <- '{' (element (',' element)* ','?)? '}'
element <- (litbody / expr) (':' (litbody / expr))?
"""

_JAVA = r"""
start <- (annots 'package' qname ';' / 'package' qname ';')? (importdecl / ';')* (topdecl / ';')* EOF
importdecl <- 'import' 'static'? qname ('.' '*')? ';'
qname <- NAME ('.' NAME)*
topdecl <- mods typedecl / modifiermodule
modifiermodule <- annots? 'open'? 'module' qname '{' (!'}' token)* '}'
token <- NAME / KW / OP / STR / NUM
mods <- ('public' / 'private' / 'protected' / 'static' / 'final' / 'abstract' / 'native' / 'synchronized' / 'transient' / 'volatile' / 'strictfp' / 'default' !':' !'->' / 'sealed' &(KW / NAME) / 'non' '-' 'sealed' / annot)*
annots <- annot+
annot <- '@' !'interface' qname ('(' (annotarg (',' annotarg)* ','?)? ')')?
annotarg <- (NAME '=')? annotval
annotval <- annot / '{' (annotval (',' annotval)* ','?)? '}' / expr
typedecl <- classdecl / interfacedecl / enumdecl / recorddecl / annotdecl
classdecl <- 'class' NAME typeparams? ('extends' type)? ('implements' types)? ('permits' types)? body
interfacedecl <- 'interface' NAME typeparams? ('extends' types)? ('permits' types)? body
annotdecl <- '@' 'interface' NAME body
recorddecl <- 'record' NAME typeparams? '(' params ')' ('implements' types)? body
enumdecl <- 'enum' NAME ('implements' types)? '{' (enumconst (',' enumconst)* ','?)? (';' member*)? '}'
enumconst <- annots? NAME args? body?
typeparams <- '<' typeparam (',' typeparam)* '>'
typeparam <- annots? NAME ('extends' type ('&' type)*)?
types <- type (',' type)*
body <- '{' member* '}'
member <- ';' / 'static'? block / mods (typedecl / typeparams? NAME '(' params ')' throws? block / NAME block / typeparams? type NAME '(' params ')' dims throws? ('default' annotval)? (block / ';') / type declarators ';')
throws <- 'throws' types
dims <- ('[' ']')*
params <- (param (',' param)*)?
param <- mods type annots? '...'? ('this' / NAME) dims
type <- annots? (prim / NAME typeargs? ('.' NAME typeargs?)*) (annots? '[' ']')*
prim <- 'int' / 'long' / 'short' / 'byte' / 'char' / 'boolean' / 'float' / 'double' / 'void'
typeargs <- '<' (typearg (',' typearg)*)? '>'
typearg <- annots? '?' (('extends' / 'super') type)? / type
declarators <- declarator (',' declarator)*
declarator <- NAME dims ('=' (arrayinit / expr))?
arrayinit <- '{' (arrayitem (',' arrayitem)*)? ','? '}'
arrayitem <- arrayinit / expr
block <- '{' stmt* '}'
stmt <- block / ';' / mods typedecl / localvar ';' / 'if' '(' expr ')' stmt ('else' stmt)? / forstmt / 'while' '(' expr ')' stmt / 'do' stmt 'while' '(' expr ')' ';' / trystmt / 'switch' switchbody / 'synchronized' '(' expr ')' block / 'return' expr? ';' / 'throw' expr ';' / 'break' NAME? ';' / 'continue' NAME? ';' / 'yield' expr ';' / 'assert' expr (':' expr)? ';' / NAME ':' stmt / exprstmt ';'
exprstmt <- &(('++' / '--') / callish) expr
callish <- postfix ('++' / '--' / assignop / &';') / 'new'
localvar <- mods type !'=' declarators
forstmt <- 'for' '(' (mods type NAME ':' expr / (localvar / exprs)? ';' expr? ';' exprs?) ')' stmt
exprs <- expr (',' expr)*
trystmt <- 'try' resources? block catch* ('finally' block)?
resources <- '(' resource (';' resource)* ';'? ')'
resource <- mods type NAME '=' expr / postfix
catch <- 'catch' '(' mods type ('|' type)* NAME ')' block
switchbody <- '(' expr ')' '{' (switchlabel ('->' (block / 'throw' expr ';' / expr ';') / ':' (!'case' !('default' (':' / '->')) stmt)*))* '}'
switchlabel <- 'case' caselabel (',' caselabel)* ('when' expr)? / 'default'
caselabel <- 'default' / recordpattern / type NAME / cond
recordpattern <- type '(' (casepat (',' casepat)*)? ')' NAME?
casepat <- recordpattern / type NAME
expr <- lambda / cond (assignop expr)?
assignop <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>' '>' '>'? '='
lambda <- (NAME / '(' (lambdaparam (',' lambdaparam)*)? ')') '->' (block / expr)
lambdaparam <- param / NAME
cond <- binary ('?' expr ':' (lambda / cond))?
binary <- unary (binop unary / 'instanceof' 'final'? (recordpattern / type NAME?))*
binop <- '||' / '&&' / '==' / '!=' / '<=' / '<<' / '+' / '-' / '*' / '/' / '%' / '&' / '|' / '^' / '<' / '>' '>' '>' / '>' '>' / '>' '=' / '>'
unary <- ('+' / '-' / '!' / '~' / '++' / '--') unary / cast / postfix ('++' / '--')*
cast <- '(' prim dims ')' unary / '(' type ('&' type)* ')' &(NAME / STR / NUM / '(' / '!' / '~' / 'this' / 'super' / 'new' / 'true' / 'false' / 'null' / 'switch') (lambda / unary)
postfix <- primary suffix*
suffix <- '.' typeargs? NAME args? / '.' 'new' creator / '.' ('this' / 'class' / 'super') / '[' expr ']' / '::' typeargs? (NAME / 'new')
args <- '(' (expr (',' expr)*)? ')'
primary <- NUM / STR / 'true' / 'false' / 'null' / 'switch' switchbody / 'this' args? / 'super' (args / '.' typeargs? NAME args? / '::' NAME) / 'new' creator / '(' expr ')' / prim dims ('.' 'class' / '::' 'new') / NAME dims '.' 'class' / NAME typeargs dims '::' (NAME / 'new') / NAME '[' ']' dims '::' 'new' / NAME args?
creator <- annots? (prim / NAME typeargs? ('.' NAME typeargs?)*) (args body? / ('[' expr ']')+ dims / '[' ']' dims arrayinit)
"""

_CSHARP = r"""
start <- (externalias / usingdecl / attribute 'assembly')* (nsdecl / topdecl / stmt)* EOF
externalias <- 'extern' 'alias' NAME ';'
usingdecl <- 'global'? 'using' ('static' / 'unsafe')? (NAME '=' type / qname) ';'
qname <- NAME (('.' / '::') NAME)*
nsdecl <- 'namespace' qname ('{' (usingdecl / nsdecl / topdecl)* '}' / ';')
attribute <- '[' (NAME ':' / 'return' ':' / 'event' ':')? attr (',' attr)* ','? ']'
attr <- qname ('(' (attrarg (',' attrarg)*)? ')')?
attrarg <- (NAME ('=' / ':'))? expr
topdecl <- attribute* mods typedecl
mods <- ('public' / 'private' / 'protected' / 'internal' / 'static' / 'sealed' / 'abstract' / 'virtual' / 'override' / 'readonly' / 'new' / 'extern' / 'unsafe' / 'volatile' / 'const' / 'async' &(KW / NAME) / 'partial' &(KW / NAME) / 'required' &(KW / NAME) / 'file' &(KW / NAME))*
typedecl <- ('class' / 'struct' / 'interface' / 'record' ('class' / 'struct')? / 'ref' 'struct') NAME typeparams? ('(' params ')')? (':' base (',' base)*)? where* (typebody ';'? / ';') / 'enum' NAME (':' type)? '{' (enumitem (',' enumitem)* ','?)? '}' ';'? / 'delegate' type NAME typeparams? '(' params ')' where* ';'
base <- type args?
enumitem <- attribute* NAME ('=' expr)?
typeparams <- '<' attribute* ('in' / 'out')? NAME (',' attribute* ('in' / 'out')? NAME)* '>'
where <- 'where' NAME ':' constraint (',' constraint)*
constraint <- 'class' '?'? / 'struct' / 'new' '(' ')' / 'notnull' / 'unmanaged' / 'default' / type
typebody <- '{' member* '}'
member <- attribute* mods (typedecl / 'event' type NAME (',' NAME)* (';' / accessors / '=' expr ';') / '~' NAME '(' ')' mbody / ('implicit' / 'explicit') 'operator' type '(' params ')' mbody / type 'operator' (opsym / 'true' / 'false') '(' params ')' mbody / NAME '(' params ')' (':' ('base' / 'this') args)? mbody / 'ref'? 'readonly'? type (qname '.')? 'this' '[' params ']' (accessors / '=>' expr ';') / 'ref'? 'readonly'? type memname typeparams? '(' params ')' where* mbody / 'ref'? 'readonly'? type memname (accessors ('=' init ';')? / '=>' expr ';') / type declarators ';')
opsym <- (!'(' OP)+
memname <- NAME typeargs? ('.' NAME typeargs?)*
mbody <- block / '=>' expr ';' / ';'
accessors <- '{' (attribute* mods ('get' / 'set' / 'init' / 'add' / 'remove') mbody)+ '}'
params <- (param (',' param)*)?
param <- attribute* ('this' / 'ref' / 'out' / 'in' / 'params' / 'scoped' &NAME)* type NAME ('=' expr)?
type <- typebase typesuffix*
typesuffix <- '?' / '[' ','* ']' / '*'
typebase <- prim / '(' type NAME? (',' type NAME?)+ ')' / 'delegate' '*' '<' type (',' type)* '>' / NAME typeargs? (('.' / '::') NAME typeargs?)*
prim <- 'int' / 'uint' / 'long' / 'ulong' / 'short' / 'ushort' / 'byte' / 'sbyte' / 'char' / 'bool' / 'float' / 'double' / 'decimal' / 'string' / 'object' / 'void'
typeargs <- '<' (type (',' type)* / ','*) '>'
declarators <- NAME ('=' init)? (',' NAME ('=' init)?)*
init <- arrayinit / expr
arrayinit <- '{' ((arrayinit / expr) (',' (arrayinit / expr))* ','?)? '}'
block <- '{' stmt* '}'
stmt <- block / ';' / localfunc / localvar ';' / 'if' '(' expr ')' stmt ('else' stmt)? / 'foreach' '(' (type pattvar / type NAME) 'in' expr ')' stmt / 'await' 'foreach' '(' type NAME 'in' expr ')' stmt / 'for' '(' (localvar / exprs)? ';' expr? ';' exprs? ')' stmt / 'while' '(' expr ')' stmt / 'do' stmt 'while' '(' expr ')' ';' / 'switch' '(' expr ')' '{' (('case' pattern ('when' expr)? / 'default') ':' (!'case' !('default' ':') stmt)*)* '}' / trystmt / ('checked' / 'unchecked' / 'unsafe') block / 'lock' '(' expr ')' stmt / 'fixed' '(' localvar ')' stmt / 'await'? 'using' '(' (localvar / expr) ')' stmt / 'return' expr? ';' / 'throw' expr? ';' / 'break' ';' / 'continue' ';' / 'goto' ('case' expr / 'default' / NAME) ';' / 'yield' ('return' expr / 'break') ';' / NAME ':' stmt / exprstmt ';'
pattvar <- '(' NAME (',' NAME)+ ')'
exprstmt <- &(('++' / '--' / 'await' / 'new') / postfix ('++' / '--' / '!' / assignop / &';')) expr
localfunc <- attribute* ('static' / 'async' / 'unsafe' / 'extern')* type NAME typeparams? '(' params ')' where* mbody
localvar <- 'await'? 'using'? ('const' / 'scoped' &NAME)? 'ref'? type !'=' declarators
exprs <- expr (',' expr)*
trystmt <- 'try' block catch* ('finally' block)?
catch <- 'catch' ('(' type NAME? ')')? ('when' '(' expr ')')? block
expr <- lambda / 'ref' expr / 'throw' expr / query / cond (assignop expr)?
assignop <- '=' !'>' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '??=' / '>' '>' '>'? '='
lambda <- ('static' / 'async' !('.' / '('  expr? ')' !'=>'))* (NAME / type? '(' (lambdaparam (',' lambdaparam)*)? ')') '=>' (block / expr)
lambdaparam <- param / NAME
query <- 'from' type? NAME 'in' expr ('from' type? NAME 'in' expr / 'let' NAME '=' expr / 'where' expr / 'join' type? NAME 'in' expr 'on' expr 'equals' expr ('into' NAME)? / 'orderby' expr ('ascending' / 'descending')? (',' expr ('ascending' / 'descending')?)*)* ('select' expr / 'group' expr 'by' expr) ('into' NAME query)?
cond <- binary ('?' expr ':' expr)?
binary <- unary (binop unary / 'is' pattern / 'as' type / 'switch' '{' (pattern ('when' expr)? '=>' expr (',' pattern ('when' expr)? '=>' expr)* ','?)? '}' / 'with' arrayinit)*
binop <- '||' / '&&' / '??' / '==' / '!=' / '<=' / '<<' / '+' / '-' / '*' / '/' / '%' / '&' / '|' / '^' / '..' / '<' / '>' '>' '>' / '>' '>' / '>' '=' / '>'
pattern <- patand ('or' patand)*
patand <- patnot ('and' patnot)*
patnot <- 'not' patnot / patatom
patatom <- ('<=' / '<' / '>' '=' / '>') unary / '[' ((pattern / '..' pattern?) (',' (pattern / '..' pattern?))*)? ']' / 'var' (NAME / pattvar) / type? '(' (subpat (',' subpat)*)? ')' propbody? NAME? / type? propbody NAME? / type !('(' / '.' / '?' !':') NAME &(')' / '&&' / '||' / ';' / ',' / ':' / '=>' / 'when' / '?' / 'and' / 'or' / ']' / '}') / unary (binop unary)*
propbody <- '{' (NAME ('.' NAME)* ':' pattern (',' NAME ('.' NAME)* ':' pattern)* ','?)? '}'
subpat <- (NAME ':')? pattern
unary <- ('+' / '-' / '!' / '~' / '++' / '--' / '&' / '*' / '^' / 'await' &(NAME / KW / '(')) unary / cast / '..' unary? / postfix ('++' / '--' / '!')*
cast <- '(' prim typesuffix* ')' unary / '(' type ')' &(NAME / STR / NUM / '(' / '!' / '~' / 'this' / 'base' / 'new' / 'true' / 'false' / 'null' / 'typeof' / 'default') unary
postfix <- primary suffix*
suffix <- ('.' / '?.') NAME typeargs? &'(' args / ('.' / '?.') NAME typeargs? / '::' NAME / '?.'? '[' arg (',' arg)* ']' / '?' '[' arg (',' arg)* ']' / args / '->' NAME / '!' &('.' / '[' / ')' / ';' / ',')
args <- '(' (arg (',' arg)*)? ')'
arg <- (NAME ':')? (('out' / 'in') (type NAME &(',' / ')') / expr) / 'ref' expr / expr)
primary <- NUM / STR / 'true' / 'false' / 'null' / 'this' / 'base' / 'typeof' '(' type ')' / 'sizeof' '(' type ')' / 'default' ('(' type ')')? / ('checked' / 'unchecked') '(' expr ')' / 'stackalloc' type ('[' expr ']')? arrayinit? / 'delegate' ('(' params ')')? block / 'new' creator / '(' arg (',' arg)* ')' / '[' ((('..')? expr) (',' ('..')? expr)* ','?)? ']' / prim / NAME typeargs &('(' / '.') / NAME
creator <- '[' ','* ']' arrayinit / args objinit? / '{' (objitem (',' objitem)* ','?)? '}' / typebase '?'? (args objinit? / '[' expr (',' expr)* ']' ('[' ','* ']')* arrayinit? / ('[' ','* ']')+ arrayinit / objinit)
objinit <- '{' (objitem (',' objitem)* ','?)? '}'
objitem <- (NAME / '[' expr ']') '=' (objinit / expr) / objinit / '{' expr (',' expr)* '}' / expr
"""

_RUST = r"""
start <- ('#' '!' '[' tree* ']')* item* EOF
tree <- '(' tree* ')' / '[' tree* ']' / '{' tree* '}' / !')' !']' !'}' (NAME / KW / OP / STR / NUM / LIFE)
attr <- '#' '!'? '[' tree* ']'
item <- attr* vis? (usedecl / fn / structdecl / enumdecl / impl / trait / moddecl / constdecl / typedecl / externblock / macroitem) / ';'
vis <- 'pub' ('(' ('crate' / 'self' / 'super' / 'in' path) ')')?
usedecl <- 'use' usetree ';' / 'extern' 'crate' NAME ('as' NAME)? ';'
usetree <- '::'? (seg '::')* ('{' (usetree (',' usetree)* ','?)? '}' / '*' / seg ('as' NAME)?)
seg <- NAME / 'crate' / 'self' / 'super' / 'Self'
fn <- ('const' / 'async' / 'unsafe' / 'extern' STR?)* 'fn' NAME generics? '(' fnparams ')' ('->' type)? where? (block / ';')
fnparams <- (fnparam (',' fnparam)* ','?)?
fnparam <- attr* ('&' LIFE? 'mut'? 'self' / 'mut'? 'self' (':' type)? / pattern ':' type / '...')
generics <- '<' (generic (',' generic)* ','?)? '>'
generic <- attr* (LIFE (':' LIFE ('+' LIFE)*)? / 'const' NAME ':' type ('=' expr)? / NAME (':' bounds?)? ('=' type)?)
bounds <- bound ('+' bound)* '+'?
bound <- LIFE / '?'? forlife? path / '(' bound ')'
forlife <- 'for' generics
where <- 'where' (whereitem (',' whereitem)* ','?)?
whereitem <- LIFE ':' bounds / forlife? type ':' bounds?
structdecl <- ('struct' / 'union' &NAME) NAME generics? (where? '{' (field (',' field)* ','?)? '}' / '(' (attr* vis? type (',' attr* vis? type)* ','?)? ')' where? ';' / where? ';')
field <- attr* vis? NAME ':' type
enumdecl <- 'enum' NAME generics? where? '{' (variant (',' variant)* ','?)? '}'
variant <- attr* NAME ('{' (field (',' field)* ','?)? '}' / '(' (attr* vis? type (',' attr* vis? type)* ','?)? ')')? ('=' expr)?
impl <- 'unsafe'? 'impl' generics? ('!'? type 'for')? type where? '{' assoc* '}'
assoc <- attr* vis? 'default'? (fn / constdecl / typedecl / macroitem)
trait <- 'unsafe'? 'auto'? 'trait' NAME generics? (':' bounds?)? where? ('{' assoc* '}' / '=' bounds ';')
moddecl <- 'unsafe'? 'mod' NAME (';' / '{' item* '}')
constdecl <- ('const' / 'static' 'mut'?) (NAME) ':' type ('=' expr)? ';'
typedecl <- 'type' NAME generics? (':' bounds?)? where? ('=' type)? where? ';'
externblock <- 'unsafe'? 'extern' STR? '{' (attr* vis? (fn / constdecl / typedecl))* '}'
macroitem <- path '!' NAME? ('{' tree* '}' / '(' tree* ')' ';' / '[' tree* ']' ';')
path <- ('::' / '<' type ('as' path)? '>' '::')? seg pathargs? ('::' (seg pathargs? / typeargs))*
pathargs <- typeargs / '(' (type (',' type)* ','?)? ')' ('->' type)?
typeargs <- '<' (typearg (',' typearg)* ','?)? '>'
typearg <- LIFE / NAME typeargs? '=' type / NAME ':' bounds / type / NUM / '-' NUM / STR / 'true' / 'false' / block
type <- '!' / '&' '&'? LIFE? 'mut'? type / '&&' LIFE? 'mut'? type / '*' ('const' / 'mut') type / '[' type (';' expr)? ']' / '(' (type (',' type)* ','?)? ')' / ('dyn' / 'impl') bounds / forlife? ('unsafe' / 'extern' STR?)* 'fn' '(' ((NAME ':')? type (',' (NAME ':')? type)* ','?)? ')' ('->' type)? / forlife? path ('!' ('(' tree* ')' / '[' tree* ']' / '{' tree* '}'))?
pattern <- '|'? patone ('|' patone)*
patone <- '&&' 'mut'? patone / '&' 'mut'? patone / '(' (pattern (',' pattern)* ','?)? ')' / '[' (pattern (',' pattern)* ','?)? ']' / '..' !patrangeend / patlit (('..=' / '..' / '...') patlit?)? / ('..=') patlit / 'ref'? 'mut'? NAME '@' pattern / path ('{' (fieldpat (',' fieldpat)* ','?)? '}' / '(' (pattern (',' pattern)* ','?)? ')' / '!' ('(' tree* ')')) / ('ref' / 'mut')+ NAME / path (('..=' / '..') patlit)?
patrangeend <- NUM
patlit <- '-'? NUM / STR / 'true' / 'false'
fieldpat <- attr* ('..' / NAME ':' pattern / NUM ':' pattern / 'ref'? 'mut'? NAME)
block <- '{' ('#' '!' '[' tree* ']')* stmt* expr? '}'
stmt <- ';' / item / attr* 'let' pattern (':' type)? ('=' expr ('else' block)?)? ';' / attr* blockexpr !('.' / '?') ';'? / attr* expr ';'
blockexpr <- (LIFE ':')? ('unsafe' block / 'async' 'move'? block / 'const' block / block / ifexpr / matchexpr / 'loop' block / 'while' cond block / 'for' pattern 'in' exprn block) / path '!' '{' tree* '}'
cond <- condpart ('&&' condpart)*
condpart <- 'let' pattern '=' letexprn / exprn
letexprn <- unaryn (!'&&' !'||' binop unaryn)*
ifexpr <- 'if' cond block ('else' (ifexpr / block))?
matchexpr <- 'match' exprn '{' (arm)* '}'
arm <- attr* pattern ('if' expr)? '=>' (blockexpr &(',' / '}' / pattern) ','? / expr (',' / &'}'))
expr <- unary ((binop / assignop) unary / 'as' type / ('..=' / '..') unary?)* / ('..=' / '..') unary?
exprn <- unaryn ((binop / assignop) unaryn / 'as' type / ('..=' / '..') unaryn?)* / ('..=' / '..') unaryn?
binop <- '||' / '&&' / '==' / '!=' / '<=' / '<<' / '+' / '-' / '*' / '/' / '%' / '&' / '|' / '^' / '<' / '>' '>' / '>' '=' / '>'
assignop <- '=' !'=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>' '>' '='
unary <- ('-' / '!' / '*' / '&&' 'mut'? / '&' ('raw' ('const' / 'mut'))? 'mut'?) unary / closure / jump / primary suffix*
unaryn <- ('-' / '!' / '*' / '&&' 'mut'? / '&' 'mut'?) unaryn / closure / jump / primaryn suffix*
jump <- 'return' expr? / 'break' LIFE? expr? / 'continue' LIFE?
closure <- ('move' / 'async' / 'static')* ('||' / '|' (closureparam (',' closureparam)* ','?)? '|') ('->' type block / expr)
closureparam <- patone (':' type)?
suffix <- '.' ('await' / NUM / NAME ('::' typeargs)?) / '?' / '(' (expr (',' expr)* ','?)? ')' / '[' expr ']'
primary <- structlit / primaryn
structlit <- path '{' (fieldinit (',' fieldinit)* (',' '..' expr)? ','? / '..' expr)? '}'
fieldinit <- attr* (NAME / NUM) (':' expr)?
primaryn <- NUM / STR / 'true' / 'false' / blockexpr / macro / '(' (expr (',' expr)* ','?)? ')' / '[' (expr (';' expr / (',' expr)* ','?))? ']' / path
macro <- path '!' ('(' macroargs ')' / '[' macroargs ']' / '{' tree* '}')
macroargs <- (macroarg (',' macroarg)* ','?)? &(')' / ']') / tree*
macroarg <- NAME '=' expr / expr
"""

_CPP = r"""
start <- decl* EOF
attr <- '[' '[' (!']' tok)* ']' ']' / 'alignas' '(' (!')' tok)* ')'
tok <- NAME / KW / OP / STR / NUM
decl <- ';' / attr / template? (nsdecl / linkage / usingdecl / typedefdecl / staticassert / classdef / enumdef / function / conversion / special / vardecl / friend) / access
nsdecl <- 'inline'? 'namespace' attr? (NAME ('::' NAME)*)? ('{' decl* '}' / '=' qname ';')
linkage <- 'extern' STR ('{' decl* '}' / decl)
usingdecl <- 'using' ('namespace' qname / NAME attr? '=' type / 'typename'? qname) ';'
typedefdecl <- 'typedef' (classspec / enumspec / type) declarator (',' declarator)* ';'
staticassert <- 'static_assert' '(' expr (',' STR)? ')' ';'
template <- ('template' '<' (tparam (',' tparam)*)? '>' requires?)+
requires <- 'requires' binary
tparam <- ('typename' / 'class' / template ('class' / 'typename')) '...'? NAME? ('=' type)? / type '...'? declarator? ('=' unary)? / qname '...'? NAME? ('=' type)?
classspec <- ('struct' / 'class' / 'union') attr* (qname)? 'final'? (':' basespec (',' basespec)*)? '{' decl* '}'
classdef <- specs classspec attr* (declarator inits? (',' declarator inits?)*)? ';' / ('struct' / 'class' / 'union') attr* qname ';'
basespec <- ('virtual' / 'public' / 'private' / 'protected')* qname '...'?
enumspec <- 'enum' ('class' / 'struct')? attr* qname? (':' type)? '{' (NAME attr* ('=' cond)? (',' NAME attr* ('=' cond)?)* ','?)? '}'
enumdef <- specs enumspec (declarator inits? (',' declarator inits?)*)? ';' / 'enum' ('class' / 'struct')? NAME (':' type)? ';'
access <- ('public' / 'private' / 'protected') ':'
friend <- 'friend' (('class' / 'struct') qname ';' / decl)
specs <- ('static' / 'inline' / 'extern' STR? / 'constexpr' / 'consteval' &(KW / NAME) / 'constinit' &(KW / NAME) / 'virtual' / 'explicit' ('(' expr ')')? / 'mutable' / 'friend' / 'thread_local' &(KW / NAME) / 'register' / 'const' / 'volatile' / attr)*
function <- specs type ptr* funcname '(' params ')' funcquals (';' / '=' ('0' / NUM / 'default' / 'delete') ';' / 'try'? ctorinit? block)
funcname <- (qname '::')? 'operator' (opsym / 'new' ('[' ']')? / 'delete' ('[' ']')? / STR NAME / type ptr*) / qname
opsym <- '(' ')' / '[' ']' / (!'(' OP)+
special <- specs (qname '::')? '~'? qname '(' params ')' funcquals (';' / '=' ('default' / 'delete') ';' / ctorinit? block)
conversion <- specs (qname '::')? 'operator' type ptr* '(' ')' funcquals (';' / '=' ('default' / 'delete') ';' / block)
funcquals <- ('const' / 'volatile' / '&&' / '&' / 'override' / 'final' / 'noexcept' ('(' expr ')')? / 'throw' '(' (type (',' type)*)? ')' / '->' type ptr* / attr / requires)*
ctorinit <- ':' meminit (',' meminit)*
meminit <- qname (args / braces) '...'?
params <- (param (',' param)*)? (','? '...')?
param <- attr* specs type abstract? ('=' (braces / assign))?
abstract <- ptr* '(' ptr+ NAME? dims ')' '(' params ')' / ptr* '...'? NAME? dims
dims <- ('[' expr? ']')*
ptr <- '*' ('const' / 'volatile')* / '&&' / '&' / qname '::' '*'
type <- ('const' / 'volatile' / 'constexpr')* (builtin / ('typename' / 'struct' / 'class' / 'enum' / 'union') qname / 'decltype' '(' expr ')' / 'auto' / qname) ('const' / 'volatile')*
builtin <- ('unsigned' / 'signed' / 'long' / 'short' / 'int' / 'char' / 'bool' / 'float' / 'double' / 'void' / 'const')+
qname <- '::'? qseg ('::' 'template'? qseg)*
qseg <- '~'? NAME typeargs? / 'operator' OP
typeargs <- '<' (typearg (',' typearg)*)? '>'
typearg <- type ptr* ('(' params ')')? dims '...'? &(',' / '>') / shift '...'? &(',' / '>')
vardecl <- specs type initdecl (',' initdecl)* ';'
initdecl <- (declarator / ptr* '[' NAME (',' NAME)* ']') (':' NUM)? inits?
declarator <- ptr* (NAME dims / qname dims / '(' ptr+ NAME? dims ')' ('(' params ')')? dims)
inits <- '=' (braces / assign) / braces / '(' (arg (',' arg)*)? ')'
braces <- '{' ((braceitem) (',' braceitem)* ','?)? '}'
braceitem <- ('.' NAME ('=' / &'{') / '[' expr ']' '=')? (braces / assign) '...'?
block <- '{' stmt* '}'
stmt <- attr* (block / ';' / 'if' 'constexpr'? '(' (initstmt)? condition ')' stmt ('else' stmt)? / 'for' '(' (initstmt? specs type ptr* (NAME / '[' NAME (',' NAME)* ']') ':' (braces / expr) / initstmt expr? ';' expr?) ')' stmt / 'while' '(' condition ')' stmt / 'do' stmt 'while' '(' expr ')' ';' / 'switch' '(' initstmt? condition ')' stmt / 'case' cond ('...' cond)? ':' / 'default' ':' / 'return' (braces / expr)? ';' / 'co_return' expr? ';' / 'break' ';' / 'continue' ';' / 'goto' NAME ';' / 'try' block catch+ / usingdecl / typedefdecl / staticassert / nsdecl / classdef / enumdef / localdecl / NAME ':' !':' / exprstmt)
exprstmt <- expr ';'
localdecl <- vardecl
initstmt <- vardecl / expr? ';'
condition <- specs type ptr* NAME ('=' (braces / assign) / braces) / expr
catch <- 'catch' '(' ('...' / specs type ptr* NAME? ) ')' block
expr <- assign (',' assign)*
assign <- 'throw' assign? / 'co_yield' assign / cond (assignop (braces / assign))?
assignop <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>' '>' '='
cond <- binary ('?' expr ':' assign)?
binary <- unary (binop unary)*
shift <- unary (sbinop unary)*
sbinop <- '||' / '&&' / '==' / '!=' / '<=' / '<<' / '+' / '-' / '*' / '/' / '%' / '&' / '|' / '^' / '<'
binop <- '||' / '&&' / '<=>' / '==' / '!=' / '<=' / '<<' / '->*' / '+' / '-' / '*' / '/' / '%' / '&' / '|' / '^' / '<' / '>' '>' / '>' '=' / '>'
unary <- ('+' / '-' / '!' / '~' / '++' / '--' / '*' / '&&' / '&' / 'co_await') unary / 'sizeof' ('...' '(' NAME ')' / '(' type ptr* dims ')' / unary) / 'alignof' '(' type ')' / 'noexcept' '(' expr ')' / newexpr / '::'? 'delete' ('[' ']')? unary / cast / postfix
cast <- '(' (builtin ptr* / ('const' / 'volatile') type ptr* / ('struct' / 'enum' / 'union') qname ptr* / qname ptr+) ')' (unary / braces) / '(' qname ')' &(NAME / NUM / STR / 'this' / 'nullptr' / 'new' / 'sizeof') unary
newexpr <- '::'? 'new' args? ('(' type ptr* ')' / type ptr*) ('[' expr ']')* (args / braces)?
postfix <- primary suffix*
suffix <- ('.' / '->') 'template'? ('~'? qname) / '[' (braces / expr)? ']' / args / '++' / '--' / braces &(')' / ';' / ',' / '.')
args <- '(' (arg (',' arg)*)? ')'
arg <- (braces / assign) '...'?
primary <- NUM / STR+ / 'true' / 'false' / 'nullptr' / 'this' / lambda / ('static_cast' / 'dynamic_cast' / 'const_cast' / 'reinterpret_cast') '<' type ptr* '>' '(' expr ')' / 'typeid' '(' (type / expr) ')' / '(' (expr / block) ')' / builtin (args / braces) / 'typename' qname (args / braces) / 'decltype' '(' expr ')' (args / braces) / 'auto' (args / braces) / qname &('(' / '{' / '::') / NAME typeargs &('(' / '{') / qname / NAME
lambda <- '[' (capture (',' capture)*)? ']' template? ('<' (tparam (',' tparam)*)? '>')? ('(' params ')')? ('mutable' / 'constexpr' / 'noexcept' ('(' expr ')')? / '->' type ptr*)* block
capture <- '=' / '&' !NAME / '*'? 'this' / '&'? '...'? NAME '...'? ('=' assign / braces)?
"""

_PYTHON = r"""
start <- NL* stmt* EOF
stmt <- compound / simple
simple <- small (';' small)* ';'? NL
block <- NL IN stmt+ DE / simple
small <- 'pass' / 'break' / 'continue' / 'return' starexprs? / raisestmt / 'global' NAME (',' NAME)* / 'nonlocal' NAME (',' NAME)* / 'del' targets / 'assert' expr (',' expr)? / importstmt / typealias / assignment / starexprs
raisestmt <- 'raise' (expr ('from' expr)?)?
importstmt <- 'import' dotted ('as' NAME)? (',' dotted ('as' NAME)?)* / 'from' ('.' / '...')* (dotted / &'import') 'import' ('*' / '(' importname (',' importname)* ','? ')' / importname (',' importname)*)
importname <- NAME ('as' NAME)?
dotted <- NAME ('.' NAME)*
typealias <- 'type' NAME typeparams? '=' expr
assignment <- (NAME / '(' single ')' / subtarget) ':' expr ('=' (yieldexpr / starexprs))? / (targets '=')+ !'=' (yieldexpr / starexprs) / single augop (yieldexpr / starexprs) / yieldexpr
augop <- '+=' / '-=' / '*=' / '/=' / '//=' / '%=' / '@=' / '&=' / '|=' / '^=' / '<<=' / '**=' / '>' '>' '='
single <- subtarget / NAME / '(' single ')'
targets <- target (',' target)* ','?
target <- '*' target / subtarget / targetatom !suffix
targetatom <- NAME / '(' targets? ')' / '[' targets? ']'
subtarget <- atom (suffix &suffix)* ('.' NAME / '[' slices ']') !suffix
compound <- decorator* (funcdef / classdef) / 'async' (forstmt / withstmt) / ifstmt / whilestmt / forstmt / trystmt / withstmt / matchstmt
decorator <- '@' namedexpr NL
funcdef <- 'async'? 'def' NAME typeparams? '(' params ')' ('->' starexprs)? ':' block
classdef <- 'class' NAME typeparams? ('(' args ')')? ':' block
typeparams <- '[' typeparam (',' typeparam)* ','? ']'
typeparam <- ('**' / '*')? NAME (':' expr)? ('=' starexpr)?
params <- (param (',' param)* ','?)?
param <- '/' / '**' NAME annot / '*' NAME? (':' starexpr)? / NAME annot ('=' expr)?
annot <- (':' expr)?
ifstmt <- 'if' namedexpr ':' block ('elif' namedexpr ':' block)* ('else' ':' block)?
whilestmt <- 'while' namedexpr ':' block ('else' ':' block)?
forstmt <- 'for' targets 'in' starexprs ':' block ('else' ':' block)?
trystmt <- 'try' ':' block (('except' '*'? (expr (',' expr)* ('as' NAME)?)? ':' block)+ ('else' ':' block)? ('finally' ':' block)? / 'finally' ':' block)
withstmt <- 'with' ('(' withitem (',' withitem)* ','? ')' / withitem (',' withitem)*) ':' block
withitem <- expr ('as' target)?
matchstmt <- 'match' starexprs ':' NL IN ('case' patterns ('if' namedexpr)? ':' block)+ DE
patterns <- patstar (',' patstar)* ','?
patstar <- '*' NAME / pat
pat <- closedpat ('|' closedpat)* ('as' NAME)?
closedpat <- '-'? NUM (('+' / '-') NUM)? / STR+ / 'None' / 'True' / 'False' / dotted ('(' ((NAME '=')? pat (',' (NAME '=')? pat)* ','?)? ')')? / '(' (patstar (',' patstar)* ','?)? ')' / '[' (patstar (',' patstar)* ','?)? ']' / '{' (mappat (',' mappat)* ','?)? '}'
mappat <- '**' NAME / closedpat ':' pat
yieldexpr <- 'yield' ('from' expr / starexprs?)
starexprs <- starexpr (',' starexpr)* ','?
starexpr <- '*' binary / namedexpr
namedexpr <- NAME ':=' expr / expr
expr <- lambda / or ('if' or 'else' expr)?
lambda <- 'lambda' lparams ':' expr
lparams <- (lparam (',' lparam)* ','?)?
lparam <- '/' / '**' NAME / '*' NAME? / NAME ('=' expr)?
or <- not (('or' / 'and') not)*
not <- 'not' not / comparison
comparison <- binary (compop binary)*
compop <- '==' / '!=' / '<=' / '<' / '>' '=' / '>' / 'not' 'in' / 'in' / 'is' 'not' / 'is'
binary <- unary (binop unary)*
binop <- '+' / '-' / '**' / '*' / '//' / '/' / '%' / '@' / '&' / '|' / '^' / '<<' / '>' '>'
unary <- ('+' / '-' / '~') unary / 'await'? atom suffix*
suffix <- '.' NAME / '(' args ')' / '[' slices ']'
args <- (arg (',' arg)* ','?)?
arg <- '**' expr / '*' expr / NAME '=' expr / namedexpr compfor*
slices <- slice (',' slice)* ','?
slice <- expr? ':' expr? (':' expr?)? / starexpr
atom <- NAME / NUM / STR+ / 'None' / 'True' / 'False' / '...' / '(' (yieldexpr / starexpr compfor+ / starexprs)? ')' / '[' (starexpr compfor+ / starexprs)? ']' / '{' (dictitems / starexpr compfor+ / starexprs)? '}'
dictitems <- dictitem (compfor+ / (',' dictitem)* ','?) &'}'
dictitem <- '**' binary / expr ':' expr
compfor <- 'async'? 'for' targets 'in' or ('if' (lambda / or))*
"""

TEXTS = {"typescript": _TS, "javascript": _override(_TS, _JS_ONLY), "go": _GO, "java": _JAVA, "csharp": _CSHARP, "rust": _RUST, "cpp": _CPP, "python": _PYTHON}


@functools.cache
def grammar(lang: str) -> Grammar:
    return Grammar(TEXTS[lang])
