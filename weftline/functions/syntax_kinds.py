"""Names of the syntax kinds of Java by the codes that graph documents store."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The kinds in the order of their codes, which count from 1.
_ORDER = """
    AnonymousClassDeclaration ArrayAccess ArrayCreation ArrayInitializer ArrayType AssertStatement Assignment Block BooleanLiteral BreakStatement
    CastExpression CatchClause CharacterLiteral ClassInstanceCreation CompilationUnit ConditionalExpression ConstructorInvocation ContinueStatement
    DoStatement EmptyStatement ExpressionStatement FieldAccess FieldDeclaration ForStatement IfStatement ImportDeclaration InfixExpression Initializer
    Javadoc LabeledStatement MethodDeclaration MethodInvocation NullLiteral NumberLiteral PackageDeclaration ParenthesizedExpression PostfixExpression
    PrefixExpression PrimitiveType QualifiedName ReturnStatement SimpleName SimpleType SingleVariableDeclaration StringLiteral SuperConstructorInvocation
    SuperFieldAccess SuperMethodInvocation SwitchCase SwitchStatement SynchronizedStatement ThisExpression ThrowStatement TryStatement TypeDeclaration
    TypeDeclarationStatement TypeLiteral VariableDeclarationExpression VariableDeclarationFragment VariableDeclarationStatement WhileStatement
    InstanceofExpression LineComment BlockComment TagElement TextElement MemberRef MethodRef MethodRefParameter EnhancedForStatement EnumDeclaration
    EnumConstantDeclaration TypeParameter ParameterizedType QualifiedType WildcardType NormalAnnotation MarkerAnnotation SingleMemberAnnotation
    MemberValuePair AnnotationTypeDeclaration AnnotationTypeMemberDeclaration Modifier UnionType Dimension LambdaExpression IntersectionType
    NameQualifiedType CreationReference ExpressionMethodReference SuperMethodReference TypeMethodReference
"""
NAMES = dict(enumerate(_ORDER.split(), 1))


def names() -> Column:
    """The names as a map from code to name."""
    return F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
