"""Domain terms kept in capitals by the preprocessor, as its default dictionaries."""

# Names of health-record resources.
RESOURCES = """
patient observation procedure condition medication encounter practitioner organization device diagnostic immunization
allergyintolerance careplan careteam goal location endpoint healthcareservice schedule slot appointment bundle composition
documentreference binary media list library measure questionnaire questionnaireresponse subscription communication
communicationrequest claim claimresponse coverage eligibilityrequest eligibilityresponse enrollmentrequest enrollmentresponse
explanationofbenefit paymentnotice paymentreconciliation valueset codesystem conceptmap structuredefinition implementationguide
searchparameter operationdefinition conformance capabilitystatement structuremap graphdefinition messagedefinition eventdefinition
activitydefinition plandefinition task provenance auditevent consent contract person relatedperson group bodystructure
substance substancespecification substanceprotein substancereferenceinformation substancesourcematerial medicationknowledge
medicationrequest medicationadministration medicationdispense medicationstatement detectedissue adverseevent researchstudy
researchsubject riskassessment clinicalimpression flag familymemberhistory molecularsequence imagingstudy diagnosticreport
specimen bodysite imagingmanifest imagingobjectselection imagingexcerpt medicinalproduct medicinalproductauthorization
medicinalproductcontraindication medicinalproductindication medicinalproductingredient medicinalproductinteraction
medicinalproductmanufactured medicinalproductpackaged medicinalproductpharmaceutical medicinalproductundesirableeffect
devicedefinition devicemetric devicecomponent deviceuserequest deviceusestatement devicerequest supplyrequest supplydelivery
inventoryreport linkage requestgroup nutritionorder visionprescription invoice account chargeitem chargeitemdefinition
""".split()

# Release names.
VERSIONS = "r4 r5 stu3 dstu2 r4b r3".split()

# Names of operations, kept as written.
OPERATIONS = """
$expand $validate $lookup $subsumes $compose $translate $populate $extract $document $transform $closure $conforms $member-match
$lastn $stats $snapshot $diff $apply $meta $meta-add $meta-delete $process-message $convert $graphql $evaluate $evaluate-measure
$collect $submit $batch $transaction $history $search $update $patch $delete $create $read $vread $capabilities
""".split()

# Names of data types.
DATATYPES = """
string boolean integer decimal uri url canonical base64binary instant date datetime time code oid id markdown unsignedint
positiveint uuid identifier humanname address contactpoint timing duration period range ratio sampleddata attachment coding
codeableconcept quantity money age count distance signature annotation reference narrative extension dosage contactdetail
contributor datarequirement parameterdefinition relatedartifact triggerdefinition usagecontext meta element resource
domainresource backboneelement primitivetype
""".split()

CAPITALS = [*RESOURCES, *VERSIONS, *DATATYPES]
