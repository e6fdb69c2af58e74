"""Expression grammars of eight programming languages, for tokens as `parsing` cuts them."""

PYTHON = """
file <- (NEWLINE / stmt)* !.
stmt <- compound / simple
simple <- small (';' small)* ';'? NEWLINE
block <- NEWLINE INDENT stmt+ DEDENT / simple
small <- 'pass' / 'break' / 'continue' / 'return' exprs? / 'raise' (expr ('from' expr)?)? / 'global' ID (',' ID)* / 'nonlocal' ID (',' ID)* / 'del' exprs / 'assert' expr (',' expr)?
  / 'import' dotted ('as' ID)? (',' dotted ('as' ID)?)* / 'from' ('.' / '...')* dotted? 'import' ('*' / '(' names ','? ')' / names) / typealias / assign
typealias <- ~'type' ID typeparams? '=' expr
dotted <- ID ('.' ID)*
names <- ID ('as' ID)? (',' ID ('as' ID)?)*
assign <- exprs (':' expr ('=' exprs)? / augmented exprs / ('=' exprs)*)
augmented <- '+=' / '-=' / '*=' / '/=' / '//=' / '%=' / '@=' / '&=' / '|=' / '^=' / '>>=' / '<<=' / '**='
compound <- decorator* (def / class) / 'if' named ':' block ('elif' named ':' block)* else? / 'while' named ':' block else?
  / 'for' targets 'in' exprs ':' block else? / 'try' ':' block (('except' '*'? (exprs ('as' ID)?)? ':' block)+ else? finally? / finally) / 'with' withs ':' block
  / 'async' (def / 'for' targets 'in' exprs ':' block else? / 'with' withs ':' block) / match
else <- 'else' ':' block
finally <- 'finally' ':' block
withs <- '(' with (',' with)* ','? ')' &':' / with (',' with)*
with <- expr ('as' star)?
decorator <- '@' named NEWLINE
typeparams <- '[' typeparam (',' typeparam)* ','? ']'
typeparam <- ('*' / '**')? ID (':' expr)? ('=' expr)?
def <- 'def' ID typeparams? '(' params? ')' ('->' expr)? ':' block
params <- param (',' param)* ','?
param <- '/' / '**' ID (':' expr)? / '*' (ID (':' star)?)? / ID (':' expr)? ('=' expr)?
class <- 'class' ID typeparams? ('(' args? ')')? ':' block
match <- ~'match' exprs ':' NEWLINE INDENT case+ DEDENT
case <- ~'case' pattern (',' pattern)* ','? ('if' named)? ':' block
pattern <- alt ('as' ID)?
alt <- (expr / '*' ID) 
exprs <- star (',' star)* ','?
star <- '*' bitor / named
named <- ID ':=' expr / expr
expr <- 'lambda' lambdaparams? ':' expr / or ('if' or 'else' expr)? / 'yield' ('from' expr / exprs)?
lambdaparams <- lparam (',' lparam)* ','?
lparam <- '/' / '**' ID / '*' ID? / ID ('=' expr)?
or <- not (('and' / 'or') not)*
not <- 'not'* bitor (compare bitor)*
compare <- '==' / '!=' / '<=' / '>=' / '<' / '>' / 'not' 'in' / 'in' / 'is' 'not' / 'is'
bitor <- unary (binary unary)*
binary <- '|' / '^' / '&' / '<<' / '>>' / '+' / '-' / '**' / '*' / '//' / '/' / '%' / '@'
unary <- ('-' / '+' / '~')* 'await'? atom trailer*
trailer <- '.' ID / '(' args? ')' / '[' subs ']'
atom <- STR+ / NUM / ID / 'None' / 'True' / 'False' / '...' / '(' (yield / compr / exprs)? ')' / '[' (compr / exprs)? ']' / '{' (dict / compr / exprs)? '}'
yield <- 'yield' ('from' expr / exprs)?
compr <- star for
for <- ('async'? 'for' targets 'in' or ('if' orcond)*)+
orcond <- ID ':=' or / or / 'lambda' lambdaparams? ':' orcond
targets <- ('*'? bitor) (',' '*'? bitor)* ','?
dict <- pair (for / (',' pair)* ','?)
pair <- '**' bitor / expr ':' expr
subs <- sub (',' sub)* ','?
sub <- expr? ':' expr? (':' expr?)? / star
args <- arg (',' arg)* ','?
arg <- '**' expr / '*' expr / ID '=' expr / ID ':=' expr / expr for?
"""

# TypeScript has the rules that stand in braces below; JavaScript is the same grammar without them.
SCRIPT = """
file <- stmt* !.
end <- ';' / &'}' / !. / NL
block <- '{' stmt* '}'
stmt <- block / ';' / 'import' !'(' !'.' import end / 'export' export / decl / 'if' '(' exprs ')' stmt ('else' stmt)? / 'for' ~'await'? '(' forhead ')' stmt / 'while' '(' exprs ')' stmt
  / 'do' stmt 'while' '(' exprs ')' ';'? / 'return' (!NL exprs)? end / 'throw' exprs end / ('break' / 'continue') (!NL ID)? end / 'try' block ('catch' ('(' bind{type?} ')')? block)? ('finally' block)?
  / 'switch' '(' exprs ')' '{' ('case' exprs ':' stmt* / 'default' ':' stmt*)* '}' / 'debugger' end / ID ':' stmt {/ tsdecl} / !('{' / 'function' / 'class') exprs end
decl <- vars end / func / class
import <- STR / {~'type'? }(ID (',' (named / '*' ~'as' ID))? / named / '*' ~'as' ID) ~'from' STR
named <- '{' (namedone (',' namedone)* ','?)? '}'
namedone <- {~'type'? }(name / STR) (~'as' name)?
export <- 'default' (func / class / expr end) / '*' (~'as' name)? ~'from' STR end / named (~'from' STR)? end / decl{ / tsdecl / '=' expr end / ~'type' named (~'from' STR)? end}
vars <- ('var' / ~'let' / 'const') varone (',' varone)*
varone <- bind{ '!'? type?} ('=' expr)?
forhead <- ('var' / ~'let' / 'const') bind{type?} (~'of' / 'in') exprs / (vars / exprs)? ';' exprs? ';' exprs? / expr (~'of' / 'in') exprs
func <- ~'async'? 'function' '*'? ID? {generics? }params{ ret?} {(}block{ / end)}
params <- '(' (param (',' param)* ','?)? ')'
param <- {decorator* modifier* }('...' bind{ '?'? type?} / bind{ '?'? type?} ('=' expr)?)
bind <- ID / '[' (','* ('...' bind / bind ('=' expr)?))* ','* ']' / '{' (bindone (',' bindone)* ','?)? '}' / 'this'
bindone <- '...' bind / propname ':' bind ('=' expr)? / ID ('=' expr)?
class <- {decorator* ~'abstract'? }'class' (!~'implements' ID)? {generics? }('extends' operand{ typeargs?})? {(~'implements' typex (',' typex)*)? }'{' member* '}'
member <- ';' / {decorator* modifier* }'static' block / {modifier* }'static'? {modifier* }accessor {generics? }params{ ret?} {(}block{ / end)} / 'static'? {modifier* }propname{ ('?' / '!')? type?} ('=' expr)? end{ / '[' ID type ']' type end}
accessor <- (~'get' / ~'set') propname / ~'async'? '*'? propname{ '?'?}
propname <- '#'? name / STR / NUM / '[' expr ']'
name <- ID / 'if' / 'for' / 'in' / 'new' / 'class' / 'function' / 'return' / 'default' / 'delete' / 'import' / 'export' / 'typeof' / 'void' / 'this' / 'null' / 'true' / 'false' / 'do' / 'while' / 'else' / 'try' / 'catch' / 'finally' / 'throw' / 'switch' / 'case' / 'break' / 'continue' / 'var' / 'const' / 'with' / 'super' / 'instanceof' / 'extends' / 'static' / 'enum' / 'debugger' / 'yield'
exprs <- expr (',' expr)*
expr <- arrow / 'yield' (!NL '*'? expr)? / operand (binop operand)* ('?' expr ':' expr)? (assign expr)?
arrow <- ~'async'? (ID / {generics? }params{ ret?}) '=>' (block / expr)
assign <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '**=' / '<<=' / '>>=' / '>>>=' / '&=' / '|=' / '^=' / '&&=' / '||=' / '??='
binop <- '+' / '-' / '*' / '/' / '%' / '**' / '===' / '!==' / '==' / '!=' / '<=' / '>=' / '<<' / '>' '>' '>' / '>' '>' / '<' / '>' / '&&' / '||' / '??' / '&' / '|' / '^' / 'in' / 'instanceof'
operand <- prefix* primary postfix* (!NL ('++' / '--'))?{ ((~'as' / ~'satisfies') ('const' / typex) / '!' !NL)*}
prefix <- '+' / '-' / '!' / '~' / '++' / '--' / 'typeof' / 'void' / 'delete' / ~'await' &operandstart
operandstart <- ID / NUM / STR / TH / '(' / '[' / 'this' / 'new' / 'function' / 'import' / 'super'
postfix <- ('.' / '?.') '#'? name / '?.' '(' args ')' / '?.' '[' exprs ']' / {typeargs? }'(' args ')' / '[' exprs ']' / STR / TH exprs (TM exprs)* TT{ / '!' &('.' / '[' / '(' / ')')}
args <- ((('...'? expr) (',' '...'? expr)*) ','?)?
primary <- ~'async'? 'function' '*'? ID? {generics? }params{ ret?} block / class / 'new' ('.' name / primary (('.' '#'? name) / '[' exprs ']')* {typeargs? }('(' args ')')?) / 'this' / 'super' / 'null' / 'true' / 'false' / 'import' / NUM / STR / TH exprs (TM exprs)* TT / ID / '#' ID
  / '(' exprs ')' / '[' (','* '...'? expr)* ','* ']' / '{' (prop (',' prop)* ','?)? '}'
prop <- '...' expr / accessor {generics? }params{ ret?} block / propname ':' expr / ID ('=' expr)?
{type <- ':' typex}
{ret <- ':' (~'asserts'? (ID / 'this') ~'is' typex / typex)}
{typex <- ('new'? generics? params '=>' typex) / '|'? typeone (('|' / '&') typeone)* ('extends' typex '?' typex ':' typex)?}
{typeone <- (~'keyof' / ~'readonly' / ~'unique' / ~'infer' / 'typeof')* typebase ('[' typex? ']' !NL)*}
{typebase <- '(' typex ')' / '[' (tupleone (',' tupleone)* ','?)? ']' / '{' (typemember (';' / ',' / NL / &'}'))* '}' / 'void' / 'null' / 'this' / 'true' / 'false' / STR / TH typex (TM typex)* TT / '-'? NUM / 'import' '(' STR ')' ('.' ID)* typeargs? / ID ('.' ID)* typeargs?}
{tupleone <- '...'? (ID '?'? ':')? typex '?'?}
{typemember <- modifier* ('[' ID (':' typex / 'in' typex (~'as' typex)?) ']' ('-' / '+')? '?'? type? / 'new'? generics? params ret? / (~'get' / ~'set')? propname '?'? (generics? params ret? / type)?)}
{typeargs <- '<' typex (',' typex)* '>'}
{generics <- '<' generic (',' generic)* ','? '>'}
{generic <- 'const'? ID ('extends' typex)? ('=' typex)?}
{modifier <- (~'public' / ~'private' / ~'protected' / ~'readonly' / ~'override' / ~'abstract' / ~'declare' / 'static') !('(' / '=' / ':' / ';' / '?' / ',' / ')' / '}')}
{decorator <- '@' ID ('.' ID)* ('(' args ')')?}
{tsdecl <- ~'declare'? (~'type' ID generics? '=' typex end / ~'interface' ID generics? ('extends' typex (',' typex)*)? '{' (typemember (';' / ',' / NL / &'}'))* '}' / 'const'? 'enum' ID '{' (enumone (',' enumone)* ','?)? '}' / (~'namespace' / ~'module') (ID ('.' ID)* / STR) block / ~'abstract' class / decl)}
{enumone <- propname ('=' expr)?}
"""

JAVA = """
file <- (annotation* 'package' qualified ';')? ('import' 'static'? qualified ('.' '*')? ';' / ';')* (typedecl / ';')* !.
qualified <- ID ('.' ID)*
annotation <- '@' !'interface' qualified ('(' (annvalue (',' annvalue)*)? ')')?
annvalue <- ID '=' annone / annone
annone <- annotation / '{' (annone (',' annone)*)? ','? '}' / expr
modifier <- annotation / 'public' / 'private' / 'protected' / 'static' / 'final' / 'abstract' / 'native' / 'synchronized' !'(' / 'transient' / 'volatile' / 'strictfp' / 'default' !(':' / '->') / ~'sealed' &modstart / ~'non-sealed'
modstart <- 'class' / 'interface' / 'abstract' / 'public' / 'static'
typedecl <- modifier* ('class' ID generics? ('extends' type)? ('implements' types)? (~'permits' types)? body / 'interface' ID generics? ('extends' types)? (~'permits' types)? body / '@' 'interface' ID body / 'enum' ID ('implements' types)? '{' enums? (';' member*)? '}' / ~'record' ID generics? '(' params? ')' ('implements' types)? body)
enums <- enumone (',' enumone)* ','?
enumone <- annotation* ID ('(' args ')')? body?
body <- '{' member* '}'
member <- ';' / 'static' block / block / typedecl / modifier* generics? (ID '(' params? ')' throws? block / type ID '(' params? ')' dims throws? (block / 'default' annone ';' / ';') / type varones ';' / ID block)
throws <- 'throws' types
params <- param (',' param)*
param <- modifier* type '...'? ('this' / ID) dims
generics <- '<' generic (',' generic)* '>'
generic <- annotation* ID ('extends' type ('&' type)*)?
types <- type (',' type)*
type <- annotation* ('int' / 'long' / 'short' / 'byte' / 'char' / 'float' / 'double' / 'boolean' / 'void' / ID typeargs? ('.' ID typeargs?)*) dims
typeargs <- '<' (typearg (',' typearg)*)? '>'
typearg <- '?' (('extends' / 'super') type)? / type
dims <- ('[' ']')*
varones <- varone (',' varone)*
varone <- ID dims ('=' (init / expr))?
init <- '{' ((init / expr) (',' (init / expr))*)? ','? '}'
block <- '{' stmt* '}'
stmt <- block / ';' / 'if' '(' expr ')' stmt ('else' stmt)? / 'for' '(' (modifier* type ID ':' expr / forinit? ';' expr? ';' (expr (',' expr)*)?) ')' stmt / 'while' '(' expr ')' stmt / 'do' stmt 'while' '(' expr ')' ';'
  / 'return' expr? ';' / 'throw' expr ';' / ('break' / 'continue') ID? ';' / 'try' ('(' resource (';' resource)* ';'? ')')? block ('catch' '(' modifier* type ('|' type)* ID ')' block)* ('finally' block)? / switch / 'synchronized' '(' expr ')' block / 'assert' expr (':' expr)? ';' / ~'yield' expr ';' / ID ':' stmt / local / typedecl / expr ';'
local <- modifier* type varones ';'
forinit <- modifier* type varones / expr (',' expr)*
resource <- modifier* type ID '=' expr / expr
switch <- 'switch' '(' expr ')' '{' (('case' (expr / type ID) (',' expr)* / 'default') (':' stmt* / '->' (block / 'throw' expr ';' / expr ';')))* '}'
expr <- lambda / ternary (assign expr)?
assign <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '>>>='
lambda <- (ID / '(' (params / ID (',' ID)*)? ')') '->' (block / expr)
ternary <- unary (binop unary / 'instanceof' 'final'? type ID?)* ('?' expr ':' expr)?
binop <- '+' / '-' / '*' / '/' / '%' / '==' / '!=' / '<=' / '>=' / '<' '<' / '>' '>' '>' / '>' '>' / '<' / '>' / '&&' / '||' / '&' / '|' / '^'
unary <- ('+' / '-' / '++' / '--' / '!' / '~')* (cast / primary postfix* ('++' / '--')?)
cast <- '(' type ('&' type)* ')' (&(ID / NUM / STR / CHR / '(' / '!' / '~' / 'this' / 'new' / 'super' / 'null' / 'true' / 'false' / 'switch') unary) / '(' ('int' / 'long' / 'short' / 'byte' / 'char' / 'float' / 'double') dims ')' unary
postfix <- '.' (typeargs? ID / 'this' / 'class' / 'super' / 'new' ID typeargs? '(' args ')' body?) / '(' args ')' / '[' expr ']' / '::' (ID / 'new')
primary <- NUM / STR / CHR / 'true' / 'false' / 'null' / 'this' / 'super' / switch / '(' expr ')' / 'new' annotation* newtype ('(' args ')' body? / ('[' expr? ']')+ init?) / ('int' / 'long' / 'short' / 'byte' / 'char' / 'float' / 'double' / 'boolean' / 'void') dims ('.' 'class' / '::' 'new') / ID dims '::' 'new' / ID
newtype <- 'int' / 'long' / 'short' / 'byte' / 'char' / 'float' / 'double' / 'boolean' / ID typeargs? ('.' ID typeargs?)*
args <- (expr (',' expr)*)?
"""

GO = """
file <- 'package' ID ';' ('import' (importone / '(' (importone ';')* importone? ')') ';')* (top ';')* top? !.
importone <- ('.' / ID)? STR
top <- 'func' ('(' params? ')')? ID typeparams? signature block? / decl
decl <- 'var' (varspec / '(' (varspec ';')* varspec? ')') / 'const' (constspec / '(' (constspec ';')* constspec? ')') / 'type' (typespec / '(' (typespec ';')* typespec? ')')
varspec <- ids (type ('=' exprs)? / '=' exprs)
constspec <- ids (type? '=' exprs)?
typespec <- ID typeparams? '='? type
typeparams <- '[' ids constraint (',' ids constraint)* ','? ']'
constraint <- '~'? type ('|' '~'? type)*
ids <- ID (',' ID)*
type <- '*' type / '[' ('...' / expr)? ']' type / 'map' '[' type ']' type / 'chan' '<-'? type / '<-' 'chan' type / 'func' signature / 'struct' '{' (field ';')* field? '}' / 'interface' '{' (method ';')* method? '}' / '(' type ')' / ID ('.' ID)? ('[' type (',' type)* ','? ']')?
field <- (ids type / '*'? ID ('.' ID)?) STR?
method <- ID signature / constraint
signature <- '(' params? ')' ('(' params? ')' / type)?
params <- param (',' param)* ','?
param <- ID '...'? type / '...'? type
block <- '{' stmts '}'
stmts <- (stmt? ';')* stmt?
stmt <- block / decl / 'return' exprs? / 'if' (simple? ';')? header block ('else' (block / stmt))? / 'for' (block / forhead block) / 'switch' (simple? ';')? header? '{' (('case' cases / 'default') ':' stmts)* '}' / 'select' '{' (('case' simple / 'default') ':' stmts)* '}'
  / 'go' expr / 'defer' expr / 'break' ID? / 'continue' ID? / 'goto' ID / 'fallthrough' / ID ':' !'=' stmt? / simple
cases <- (type / expr) (',' (type / expr))*
forhead <- (hexprs (':=' / '='))? 'range' hexpr / hsimple? ';' hexpr? ';' hsimple? / hexpr
header <- hsimple
simple <- exprs ((':=' / assign) exprs / '++' / '--' / '<-' expr)?
hsimple <- hexprs ((':=' / assign) hexprs / '++' / '--' / '<-' hexpr)?
assign <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '&^='
exprs <- expr (',' expr)*
hexprs <- hexpr (',' hexpr)*
expr <- unary (binop unary)*
hexpr <- hunary (binop hunary)*
binop <- '+' / '-' / '*' / '/' / '%' / '==' / '!=' / '<=' / '>=' / '<<' / '>>' / '<' / '>' / '&&' / '||' / '&^' / '&' / '|' / '^'
unary <- ('+' / '-' / '!' / '^' / '*' / '&' / '<-')* primary postfix*
hunary <- ('+' / '-' / '!' / '^' / '*' / '&' / '<-')* hprimary hpostfix*
postfix <- hpostfix / '{' elements '}'
hpostfix <- '.' (ID / '(' ('type' / type) ')') / '(' ((type / expr) (',' (type / expr))* '...'? ','?)? ')' / '[' (expr? ':' expr? (':' expr)? / type (',' type)* / expr) ']'
elements <- (element (',' element)* ','?)?
element <- ('{' elements '}' / expr) (':' ('{' elements '}' / expr))?
hprimary <- NUM / STR / CHR / 'func' signature block / '(' (expr / type) ')' / ('[' ('...' / expr)? ']' type / 'map' '[' type ']' type / 'struct' '{' (field ';')* field? '}') (&'(' / '{' elements '}') / 'chan' type / 'interface' '{' '}' / ID
primary <- hprimary
"""

# C++ has the rules that stand in braces below; C is the same grammar without them.
C = """
file <- top* !.
top <- ';' / {'namespace' attribute? ID? ('::' ID)* '{' top* '}' / 'extern' STR ('{' top* '}' / top) / template top / using / }'_Static_assert' '(' expr ',' STR ')' ';' / function / declaration{ / 'static_assert' '(' expr (',' STR)? ')' ';' / 'friend' top}
{template <- 'template' '<' (tparam (',' tparam)*)? '>' ('requires' unary)?}
{tparam <- ('class' / 'typename' / template 'class') '...'? ID? ('=' typename)? / typename '...'? ID? ('=' operand)?}
{using <- 'using' ('namespace' qualified / ID attribute? '=' typename / 'typename'? qualified) ';'}
{attribute <- '[' '[' (!']' .)* ']' ']'}
{qualified <- '::'? ID targs? ('::' 'template'? ('~'? ID targs? / 'operator' opname))*}
{targs <- '<' (targ (',' targ)*)? '>'}
{targ <- (typename / shiftless) '...'?}
{shiftless <- prefix* primary postfix*}
{opname <- '(' ')' / '[' ']' / 'new' / 'delete' / STR ID / '+=' / '-=' / '*=' / '/=' / '==' / '!=' / '<=' / '>=' / '<<' / '++' / '--' / '->' / '&&' / '||' / '>' '>' / '+' / '-' / '*' / '/' / '%' / '<' / '>' / '=' / '!' / '&' / '|' / '^' / '~' / typename}
function <- {attribute* }specs{?} declarator {('const' / 'noexcept' ('(' expr ')')? / 'override' / 'final' / '&' / '&&')* ('->' typename)? (':' ctorinit (',' ctorinit)*)? 'try'? }block
{ctorinit <- qualified ('(' args ')' / '{' args '}')}
declaration <- {attribute* }specs (initone (',' initone)*)? ';'
specs <- {attribute* }spec* (intword (intword / spec)* ('int' / 'char' / 'double')? (intword / spec)* / type (intword / spec)*)
intword <- 'signed' / 'unsigned' / 'short' / 'long'
spec <- 'static' / 'const' / 'extern' / 'inline' / 'typedef' / 'register' / 'volatile' / 'restrict' / '_Noreturn' / '__attribute__' '(' '(' (!')' .)* ')' ')'{ / 'constexpr' / 'consteval' / 'constinit' / 'virtual' / 'explicit' ('(' expr ')')? / 'mutable' / 'thread_local' / 'friend'}
type <- 'void' / 'int' / 'char' / 'float' / 'double' / 'bool' / '_Bool' / 'auto' / 'unsigned' / 'signed' / 'long' / 'short' / record / enum{ / 'decltype' '(' expr ')' / 'typename' qualified / qualified} / ID
record <- ('struct' / 'union'{ / 'class'}) {attribute* }(ID{ targs?} {'final'? (':' base (',' base)*)? }('{' field* '}')? / '{' field* '}')
{base <- ('public' / 'private' / 'protected' / 'virtual')* qualified}
field <- ';' / {('public' / 'private' / 'protected') ':' / using / template field / record ';' / special / function / }specs (initone (',' initone)*)? ';'
{special <- ('virtual' / 'explicit' / 'inline' / 'constexpr' / 'friend')* ('~'? ID / 'operator' opname) '(' params? ')' ('const' / 'noexcept' / 'override' / 'final')* ('=' ('default' / 'delete' / NUM) ';' / ';' / (':' ctorinit (',' ctorinit)*)? block)}
enum <- 'enum' {('class' / 'struct')? }ID? {(':' typename)? }('{' (ID ('=' expr)? (',' ID ('=' expr)?)* ','?)? '}')?
initone <- declarator (':' expr)? {('const' / 'noexcept' / 'override' / 'final')* ('->' typename)? }('=' ({'default' / 'delete' / }init / expr){ / '{' args '}' / '(' args ')'})?
init <- '{' (initelem (',' initelem)* ','?)? '}'
initelem <- (('.' ID / '[' expr ']')+ '=')? (init / expr)
declarator <- pointer* (('(' declarator ')' / {'operator' opname / '[' ID (',' ID)* ']' / '~'? qualified / '...' ID / }ID) suffix* / suffix+)
pointer <- '*' / 'const' / 'restrict' / 'volatile'{ / '&&' / '&' / ID '::' '*'}
suffix <- '[' expr? ']' / '(' params? ')'
params <- 'void' &')' / param (',' param)* (',' '...')? / '...'
param <- specs (declarator / pointer* {'...'? }('[' expr? ']')*){ ('=' expr)?}
typename <- specs (pointer / '(' '*' ')' '(' params? ')' / '[' expr? ']'{ / '(' params? ')'})*
block <- '{' stmt* '}'
stmt <- block / ';' / 'if' {'constexpr'? }'(' {(simpledecl / exprs ';')? (specs declarator '=' expr / }exprs{)} ')' stmt ('else' stmt)? / 'for' '(' {(specs declarator ':' (init / expr) / }(declaration / exprs? ';') exprs? ';' exprs?{)} ')' stmt / 'while' '(' exprs ')' stmt / 'do' stmt 'while' '(' exprs ')' ';' / 'return' ({init / }exprs)? ';'
  / ('break' / 'continue') ';' / 'goto' ID ';' / 'switch' '(' exprs ')' stmt / 'case' expr ('...' expr)? ':' / 'default' ':' / ID ':' !':' / {'throw' expr? ';' / 'try' block ('catch' '(' ('...' / specs declarator / typename) ')' block)+ / using / template? }declaration / exprs ';'
{simpledecl <- specs declarator ('=' expr / '{' args '}')? ';'}
exprs <- expr (',' expr)*
expr <- operand ('?' exprs ':' expr)? (assign ({init / }expr))?
operand <- unary (binop unary)*
assign <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>' '>='
binop <- '+' / '-' / '*' / '/' / '%' / '==' / '!=' / '<=' / '>=' / '<<' / '>' '>' / '<' / '>' / '&&' / '||' / '&' / '|' / '^'{ / '->*' / '.*' / '<=>'}
unary <- prefix* (cast / primary postfix*)
prefix <- '++' / '--' / '+' / '-' / '!' / '~' / '*' / '&' / 'sizeof' !('(' typename ')'){ / '&&'}
cast <- '(' typename ')' (init postfix* / &(ID / NUM / STR / CHR / '(' / '!' / '~' / '*' / '&' / '-' / 'sizeof'{ / 'this' / 'new' / 'nullptr' / 'true' / 'false'}) unary) / 'sizeof' '(' typename ')'
postfix <- '.' {'template'? '~'? qualified / 'operator' opname / }ID / '->' {qualified / }ID / '(' args ')' / '[' exprs ']' / '++' / '--'{ / '{' args '}' / '...'}
args <- (({init / }expr) (',' ({init / }expr))*{ '...'?})?
primary <- NUM / (STR / ID &STR)+ / CHR / '(' exprs ')' / '(' block ')' / {'this' / 'nullptr' / 'true' / 'false' / lambda / 'throw' expr? / '::'? 'new' ('(' args ')')? specs '*'* ('[' expr ']')* ('(' args ')' / '{' args '}')? / '::'? 'delete' ('[' ']')? unary / 'typeid' '(' (typename / expr) ')'
  / ('static_cast' / 'dynamic_cast' / 'reinterpret_cast' / 'const_cast') '<' typename '>' '(' expr ')' / ('int' / 'char' / 'float' / 'double' / 'bool' / 'long' / 'unsigned' / 'auto') ('(' args ')' / '{' args '}') / qualified / }ID
{lambda <- '[' (('=' / '&' / ('&'? ('this' / ID) ('=' expr)?)) (',' ('&'? ('*'? 'this' / ID) ('=' expr)?))*)? ']' targs? ('(' params? ')')? 'mutable'? 'noexcept'? ('->' typename)? block}
"""

RUST = """
file <- innerattr* item* !.
innerattr <- '#' '!' '[' tokens ']'
attr <- '#' '[' tokens ']'
tokens <- ('(' tokens ')' / '[' tokens ']' / '{' tokens '}' / !('(' / ')' / '[' / ']' / '{' / '}') .)*
vis <- 'pub' ('(' ('crate' / 'self' / 'super' / 'in' path) ')')?
item <- attr* vis? (use / fn / struct / enum / union / impl / trait / mod / const / alias / externblock / macrodef / 'extern' 'crate' ID ('as' ID)? ';') / macrocall ';'? 
macrocall <- path '!' ('(' tokens ')' / '[' tokens ']' / '{' tokens '}')
macrodef <- ~'macro_rules' '!' ID ('{' tokens '}' / '(' tokens ')' ';')
use <- 'use' usetree ';'
usetree <- '::'? ((useseg '::')* ('*' / '{' (usetree (',' usetree)* ','?)? '}' / useseg ('as' (ID / '_'))?))
useseg <- ID / 'crate' / 'self' / 'super'
fn <- ('const' / 'async' / 'unsafe' / 'extern' STR?)* 'fn' ID generics? '(' fnparams? ')' ('->' type)? where? (block / ';')
fnparams <- fnparam (',' fnparam)* ','?
fnparam <- attr* ('&' LIFE? 'mut'? 'self' / 'mut'? 'self' (':' type)? / pattern ':' type / '...')
LIFE <- CHR
generics <- '<' (generic (',' generic)* ','?)? '>'
generic <- attr* (LIFE (':' LIFE ('+' LIFE)*)? / 'const' ID ':' type ('=' expr)? / ID (':' bounds?)? ('=' type)?)
where <- 'where' (whereone (',' whereone)* ','?)?
whereone <- LIFE ':' bounds / forlt? type ':' bounds?
forlt <- 'for' generics
bounds <- bound ('+' bound)* '+'?
bound <- LIFE / '?'? forlt? path / '(' bound ')'
struct <- 'struct' ID generics? (where? '{' (fieldone (',' fieldone)* ','?)? '}' / ('(' (tfield (',' tfield)* ','?)? ')')? where? ';')
union <- ~'union' ID generics? where? '{' (fieldone (',' fieldone)* ','?)? '}'
fieldone <- attr* vis? ID ':' type
tfield <- attr* vis? type
enum <- 'enum' ID generics? where? '{' (variant (',' variant)* ','?)? '}'
variant <- attr* ID ('(' (tfield (',' tfield)* ','?)? ')' / '{' (fieldone (',' fieldone)* ','?)? '}')? ('=' expr)?
impl <- 'unsafe'? 'impl' generics? 'const'? '!'? type ('for' type)? where? '{' innerattr* assoc* '}'
trait <- 'unsafe'? 'trait' ID generics? (':' bounds?)? where? '{' assoc* '}'
assoc <- attr* vis? ~'default'? (fn / const / 'type' ID generics? (':' bounds)? where? ('=' type)? ';' / macrocall ';'?)
mod <- 'unsafe'? 'mod' ID ('{' innerattr* item* '}' / ';')
const <- ('const' / 'static' 'mut'?) (ID / '_') (':' type)? ('=' expr)? ';'
alias <- 'type' ID generics? where? '=' type ';'
externblock <- 'unsafe'? 'extern' STR? '{' item* '}'
type <- '(' (type (',' type)* ','?)? ')' / '!' / '&' '&'? LIFE? 'mut'? type / '*' ('const' / 'mut') type / '[' type (';' expr)? ']' / forlt? ('unsafe' / 'extern' STR?)* 'fn' '(' (type (',' type)* ','?)? ')' ('->' type)? / ('impl' / 'dyn') bounds / '_' / '<' type ('as' path)? '>' ('::' seg)+ / path ('+' LIFE)?
path <- '::'? seg ('::' seg)*
seg <- (ID / 'self' / 'super' / 'crate' / 'Self') ('::'? gargs / '(' (type (',' type)*)? ')' ('->' type)?)?
gargs <- '<' (garg (',' garg)* ','?)? '>'
garg <- LIFE / ID '=' type / ID ':' bounds / type / NUM / STR / block / '-' NUM
block <- '{' innerattr* stmt* '}'
stmt <- ';' / attr* let / item / attr* blocklike !('.' / '?') / expr ';' / expr &'}'
let <- 'let' pattern (':' type)? ('=' expr ('else' block)?)? ';'
blocklike <- ('unsafe' / 'async' 'move'?)? block / if / match / (LIFE ':')? ('loop' block / 'while' cond block / 'for' pattern 'in' nexpr block)
if <- 'if' cond block ('else' (if / block))?
cond <- condone ('&&' condone)*
condone <- 'let' pattern '=' nrange / nexpr
match <- 'match' nexpr '{' (attr* pattern ('if' cond)? '=>' (blocklike ','? / expr (',' / &'}')))* '}'
pattern <- '|'? patone ('|' patone)*
patone <- ('ref' / 'mut')* ID !('::' / '(' / '{' / '!') ('@' patone)? ((('..=' / '...' / '..') patlit)?) / patlit (('..=' / '...' / '..') patlit?)? / ('..=' / '..') patlit? / '_' / '&' '&'? 'mut'? patone / '(' (pattern (',' pattern)* ','?)? ')' / '[' (pattern (',' pattern)* ','?)? ']' / macrocall / path ('(' (pattern (',' pattern)* ','?)? ')' / '{' (patfield (',' patfield)* ','?)? '}')?
patlit <- '-'? NUM / STR / CHR / 'true' / 'false' / path !('(' / '{' / '!')
patfield <- attr* ('..' / (ID / NUM) ':' pattern / 'ref'? 'mut'? ID)
expr <- range (assign expr)?
assign <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>' '>='
range <- ('..=' / '..') binary? / binary (('..=' / '..') binary?)?
binary <- unary (binop unary / 'as' type)*
nexpr <- nrange (assign nexpr)?
nrange <- ('..=' / '..') nbinary? / nbinary (('..=' / '..') nbinary?)?
nbinary <- nunary (binop nunary / 'as' type)*
binop <- '+' / '-' / '*' / '/' / '%' / '==' / '!=' / '<=' / '>=' / '<<' / '>' '>' / '<' / '>' / '&&' / '||' / '&' / '|' / '^'
unary <- ('-' / '!' / '*' / '&' 'mut'? / '&&' 'mut'?)* primary postfix*
nunary <- ('-' / '!' / '*' / '&' 'mut'? / '&&' 'mut'?)* nprimary postfix*
postfix <- '?' / '.' ('await' / NUM / ID ('::' gargs)?) / '(' (expr (',' expr)* ','?)? ')' / '[' expr ']'
primary <- structlit / nprimary
structlit <- path '{' ((attr* (ID / NUM) (':' expr)? (',' attr* (ID / NUM) (':' expr)?)*)? ','? ('..' expr)?) '}'
nprimary <- NUM / STR+ / closure / blocklike / 'return' expr? / 'break' LIFE? expr? / 'continue' LIFE? / CHR / 'true' / 'false' / '(' (expr (',' expr)* ','?)? ')' / '[' (expr (';' expr / (',' expr)* ','?))? ']' / macrocall / '<' type ('as' path)? '>' ('::' seg)+ / path / 'let' pattern '=' nrange
closure <- 'static'? 'async'? 'move'? ('||' / '|' (cparam (',' cparam)* ','?)? '|') ('->' type block / expr)
cparam <- patone (':' type)?
"""


def _variant(text: str, full: bool) -> str:
    """The grammar with the parts in braces, or without them. Braces in quotes are lexemes and stay."""
    out, depth, quoted = [], 0, False
    for c in text:
        if c == "'":
            quoted = not quoted
        if not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if out and out[-1] != "\n":
                out.append(" ")
            continue
        if full or not depth:
            out.append(c)
    return "".join(out)


TEXTS = {
    "python": PYTHON, "javascript": _variant(SCRIPT, False), "typescript": _variant(SCRIPT, True), "java": JAVA, "go": GO, "c": _variant(C, False), "cpp": _variant(C, True), "rust": RUST,
}

# For each language: rules that end at a code, the code, and the lexemes that must not stand before it (see `peg.Grammar`).
_BLOCKS = "{ } if else for while do switch case default try catch finally"
BOUNDS = {
    "python": ("simple", "L", ""), "javascript": ("stmt", ";", f"{_BLOCKS} function class"), "typescript": ("stmt", ";", f"{_BLOCKS} function class"),
    "java": ("stmt member", ";", f"{_BLOCKS} class interface enum synchronized"), "go": ("stmt", ";", "{ } if else for switch case default select func"),
    "c": ("top stmt field", ";", _BLOCKS), "cpp": ("top stmt field", ";", f"{_BLOCKS} template namespace"), "rust": ("stmt item", ";", "{ } if else match for while loop fn impl trait mod unsafe async"),
}
